"""Operators 8 and 10 against brute force, and their edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, count long, gid string"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, 8, 9, "g") for i, t in enumerate(texts)], SCHEMA)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


EDGES = [None, "", "  \t\n", "One", "one TWO", "a b c", "A B C", "é É x y", "word " * 3000, "a\x0bb\x0cc\x85d e"]


@pytest.mark.parametrize("text", EDGES)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_STEP", 64)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def brute_components(pairs):
    least = {}
    values = [f for _, f in pairs]
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if bin((values[i] ^ values[j]) & (2**64 - 1)).count("1") <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    for (doc, _), g in zip(pairs, group):
        least[g] = min(least.get(g, doc), doc)
    return {(doc, f): least[g] for (doc, f), g in zip(pairs, group)}


def test_finer_blocks_share_what_linked_fingerprints_share():
    rng = np.random.default_rng(2)
    for mask in (*simhash.BLOCKS, *simhash.finer(simhash.BLOCKS[1])):
        below = [m & simhash.MASK for m in simhash.finer(mask)]
        upper = mask & simhash.MASK
        assert below[0] & below[1] & below[2] == upper and below[0] | below[1] | below[2] == simhash.MASK
        rest = [b for b in range(64) if not upper >> b & 1]
        for _ in range(50):
            flips = sum(1 << int(b) for b in rng.choice(rest, 2, replace=False))
            assert any(not flips & m for m in below)


@pytest.mark.parametrize("most", [1 << 16, 2])
def test_components_match_brute_force(spark, most):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 12)
    pairs = []
    for i in range(150):
        f = int(rng.choice(centres))
        for b in set(rng.integers(0, 63, rng.integers(0, 5)).tolist()):
            f ^= 1 << b
        pairs.append((int(1000 - i), f))
    pairs += [(5000, 0), (5001, 0), (5002, 1), (5003, -1)]
    frame = spark.createDataFrame(pairs, "doc_id long, fp long")
    found = dict((r["fp"], r["component_id"]) for r in simhash.components(frame, group_most=most).collect())
    assert all(found[f] == c for (_, f), c in brute_components(pairs).items())


def test_sums_of_links_never_overflow(spark):
    n = 20_000_000
    links = spark.range(n).select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"))
    count, _, total = components._sum(links)
    assert count == n and total is not None


def test_rounds_that_end_too_early_are_an_error(spark):
    path = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    assert {r["root"] for r in components.connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.connected_components(path, most_rounds=1)


def test_report_and_stage_edges(spark):
    texts = [*EDGES, "one two three four five six seven eight", "one two three four five six seven eight"]
    frame = docs(spark, texts)
    rows = {r["doc_id"]: r for r in simhash.report(frame).collect()}
    assert len(rows) == len(texts)
    assert {rows[i]["component_id"] for i in (0, 1, 2)} == {0} and rows[0]["fingerprint"] == "0" * 16
    assert rows[11]["component_id"] == 10 and rows[6]["component_id"] == 5
    kept = simhash.stage(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in rows.values()})
    twice = frame.unionByName(frame)
    assert sorted(r["doc_id"] for r in simhash.stage(twice).collect()) == sorted({r["component_id"] for r in rows.values()})
    assert simhash.report(frame.limit(0)).count() == 0 and simhash.stage(frame.limit(0)).count() == 0


def test_stage_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = np.random.default_rng(5)
    fresh = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))
    a, b, c, d, e, f = (fresh() for _ in range(6))
    # null ids of three texts, one of them copied to id 4; id 7 with four texts, one of them a copy of id 3's
    rows = [(None, a), (None, a), (None, b), (None, c), (4, c), (3, d), (7, d), (7, e), (7, e), (7, f), (9, b.upper())]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, 9, "g") for i, t in rows], SCHEMA)
    kept = simhash.stage(frame)
    assert kept.columns == frame.columns
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(-1, a), (9, b.upper()), (4, c), (3, d), (7, e), (7, f)], key=str)
    assert {tuple(r)[2:] for r in kept.collect()} == {("en", "s", 1, 7, 8, 9, "g")}


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark):
    texts = [*EDGES, "a a a a", "a b a b a b", "x\nx\n\nx\n y", "# a $ b\n# a $ b", "a b c d a b c", "\n\n", "ab " * 5 + "ü✓ 😀", "p q r s p q r t p q r"]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rules.report(docs(spark, texts)).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_outliers(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "ka lo mi ne pu ra si to".split() for b in "da fe gi ho ju".split()]
    clean = [" ".join(rng.choice(words, rng.integers(80, 400))) for _ in range(150)]
    bad = [" ".join(w + "###" for w in rng.choice(words, 120)) for _ in range(40)]
    frame = docs(spark, clean + bad)
    rows = {r["doc_id"]: r for r in rules.report(frame).collect()}
    assert all(rows[i]["kept"] for i in range(150)) and not any(rows[i]["kept"] for i in range(150, 190))
    kept = rules.stage(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(150))


def brute_verdicts(frame, least_rows=60):
    """The method over gathered rows in numpy: distances of all rows by doc_id."""
    eps, floors = 1e-9, np.array(rules.FLOORS)
    stats = {i: plain_statistics(t) for i, (t, _, _) in frame.items()}
    lines = {i: max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))) for i, (t, _, _) in frame.items()}
    z = {i: np.array([np.log(n), np.log(c / n), np.sqrt(s / c), np.sqrt(d / lines[i]), np.sqrt(r / n)]) for i, (n, c, s, d, r) in stats.items() if n}
    of = defaultdict(list)
    for i in z:
        of[frame[i][1:]].append(i)
    pooled = defaultdict(list)
    for (lang, source), ids in of.items():
        small = [k for k, v in of.items() if k[0] == lang and len(v) < least_rows]
        name = (lang, source) if len(ids) >= least_rows else (lang,) if sum(len(of[k]) for k in small) >= least_rows else ()
        pooled[name] += ids
    out = dict.fromkeys(frame)

    def estimate(x, w, factor):
        m = (w[:, None] * x).sum(0) / w.sum()
        cov = factor * ((w[:, None] * x).T @ x / w.sum() - np.outer(m, m))
        cov[np.diag_indices(5)] = np.maximum(np.diag(cov), 0) + floors**2
        return m, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def distance(x, m, q):
        return np.maximum(np.einsum("ni,ij,nj->n", x - m, q, x - m), 0)

    def half(x, m, q):
        bins = np.floor(np.log(distance(x, m, q) + eps) * 32)
        need, w = np.ceil(len(x) / 2), np.zeros(len(x))
        for b in np.unique(bins):
            here = bins == b
            w[here] = min(1.0, max(0.0, need) / here.sum())
            need -= here.sum()
        return estimate(x, w, rules._consistency(0.5))

    sets = [ids for ids in pooled.values() if len(ids) >= 10]
    xs, bests = [np.array([z[i] for i in ids]) for ids in sets], []
    for x in xs:
        centre = np.median(np.floor(np.abs(x) * 100 + 0.5) / 100 * np.sign(x), axis=0)
        away = np.median(np.floor(np.abs(x - centre) * 100 + 0.5) / 100, axis=0)
        found = [(centre, np.diag(1 / ((1.4826 * away) ** 2 + floors**2)), 0.0), estimate(x, np.ones(len(x)), 1.0)]
        for _ in range(2):
            found = [half(x, m, q) for m, q, _ in found]
        bests.append(min(found, key=lambda f: f[2]))
    for _ in range(8):
        better = [half(x, *b[:2]) for x, b in zip(xs, bests, strict=True)]
        if not any(new[2] < old[2] - rules.FALL for new, old in zip(better, bests, strict=True)):
            break
        bests = better
    for ids, x, best in zip(sets, xs, bests, strict=True):
        w = (distance(x, *best[:2]) <= rules._quantile(0.975, 5)).astype(float)
        m, q, _ = estimate(x, w, rules._consistency(0.975))
        out.update(zip(ids, distance(x, m, q), strict=True))
    return stats, out


@pytest.mark.parametrize("few", [50_000, 0])
def test_verdicts_match_brute_force(spark, monkeypatch, few):
    """Also where estimates are joined by salted keys."""
    monkeypatch.setattr(rules, "BROADCAST_ROWS", few)
    monkeypatch.setattr(rules, "SALTS", 3)
    rng = np.random.default_rng(11)
    rows = {}
    for i in range(260):
        words = rng.choice([f"{a}{b}{'#' * int(rng.random() < 0.02)}" for a in "ka lo mi ne".split() for b in "da fegi ho jumala".split()], rng.integers(20, 300))
        if i % 17 == 0:
            words = [w + "$%#" for w in words]
        text = " ".join(words) if i % 5 else "\n".join([" ".join(words[:30])] * 4 + list(words))
        lang, source = ("a", "x") if i % 2 else ("a", f"s{i % 7}") if i % 3 else (None, None)
        rows[i] = (text if i % 41 else None, lang, source)
    stats, want = brute_verdicts(rows)
    frame = spark.createDataFrame([(i, t, lang, source) for i, (t, lang, source) in rows.items()], "doc_id long, text string, lang string, source string")
    level = rules._quantile(0.99999, 5)
    got = {r["doc_id"]: r for r in rules.report(frame).collect()}
    for i, d in want.items():
        assert (d is None) == (got[i]["distance"] is None) and (d is None or abs(d - got[i]["distance"]) < 1e-6 * (1 + d)), i
        n, repeated = stats[i][0], stats[i][4]
        assert got[i]["kept"] == (n >= 50 and 100 * repeated <= 50 * n and (d is None or d <= level)), i
    assert 0 < sum(r["kept"] for r in got.values()) < sum(not r["base_failed"] for r in got.values())


def test_stage_keeps_columns_of_any_name(spark):
    frame = docs(spark, ["a b c d"] * 3).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2)).withColumn("z1", F.lit(3))
    assert rules.stage(frame).columns == frame.columns and rules.stage(frame).count() == 0


def test_equal_hashes_of_other_words_are_told_apart(spark, monkeypatch):
    """Every window gets the same hash: words decide alone."""
    monkeypatch.setattr(rules, "HASH", "(-1L + 0 * length({0}))")
    texts = ["a b c d", "a b c a b c", "a b c d a b c e f g", "x y z p q r x y z", "a a a a", "a b"]
    rows = {r["doc_id"]: r["n_repeat_words"] for r in rules.base(docs(spark, texts), ["doc_id"]).collect()}
    assert rows == {i: plain_statistics(t)[4] for i, t in enumerate(texts)}


def test_rules_small_and_empty(spark):
    frame = docs(spark, ["a b c", None], lang=None, source=None)
    assert [r["kept"] for r in rules.report(frame).collect()] == [False, False]
    assert rules.report(frame.limit(0)).count() == 0 and rules.stage(frame.limit(0)).count() == 0


def test_chi_square():
    assert abs(rules._quantile(0.975, 5) - 12.8325) < 1e-3 and abs(rules._quantile(0.5, 5) - 4.3515) < 1e-3


def test_rules_are_native(spark, monkeypatch):
    """Every job of the main path: what is written on the way, and the last plan."""
    plans, write = [], rules.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(rules, "written", seen)
    for last in (rules.report(docs(spark, ["a b c d"] * 3)), rules.stage(docs(spark, ["a b c d"] * 3))):
        plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 15 and not any(w in p for p in plans for w in ("Python", "Pandas", "Arrow"))

"""Operators 3 and 7, and op2: brute force, SQL, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import decontam, langid, quality
from corpusloom.llm.common import text_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, met = set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if i + n <= len(w) and (found := windows.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)] + ["é", "Ünd", "the"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 12, 13, 14, 30, 60])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "--- !"), (7, "again the SAME id as seven but other words to make a window long enough here"), (93, "the the the " * 9)]
    docs = []
    for i in range(60):
        body = rng.choices(pool, k=rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(w) - 12))
            body[rng.randrange(0, len(body) + 1) : 0] = w[a : a + rng.choice([5, 12, 13, 20, 60])]
        docs.append((i, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "The THE the " * 400), (104, docs[0][1]), (104, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_winnowing_matches_brute_force(spark, case, block):
    docs, items = case
    d = spark.createDataFrame([(*x, "en", 1) for x in docs], "doc_id long, text string, items string, n_words long")
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    found = decontam.match(d, b, block_words=block)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in found.collect())
    assert got == brute(docs, items)
    if block == 200_000:
        assert sorted(tuple(r) for r in decontam.report(d, b).collect()) == got


def test_winnowing_sql(spark, case):
    docs, items = case
    docs = docs[:-2]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(decontam.REPORT_SQL).fetchall()) == brute(docs, items)


def test_decontamination_stage_and_empty(spark, case):
    docs, items = case
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.stage(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x[0] for x in brute(docs, items) if not x[5])
    assert decontam.report(d.limit(0), b).count() == 0
    assert not [r for r in decontam.report(d, b.limit(0)).collect() if r["contaminated"]]


def test_guarantee_of_fingerprints():
    """Every window of 13 words holds a fingerprint that both sides keep."""
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 6, 400).astype(np.uint64)
    kept = decontam.winnowed(decontam.gram_hashes(hashes, np.zeros(400, np.int64), decontam.GRAM))
    assert all(kept[i : i + decontam.PICK].any() for i in range(400 - 12))


def syllables(seed, alphabet, n, rng):
    parts = np.random.default_rng(seed).choice(list(alphabet), (30, 3))
    parts = ["".join(p) for p in parts]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = np.random.default_rng(9)
    kinds = {"aa": "abcdefgh", "bb": "ijklmnoé", "cc": "pqrstuvü"}
    rows = [(i, syllables(k, kinds[lang], int(rng.integers(3, 60)), rng), lang, "x", 0.5) for i in range(300) for k, lang in [(i % 3, sorted(kinds)[i % 3])]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "aa"), (903, "¿¡€…", "bb"), (904, "abcabc " * 5000, None), (905, "a" * 1000, "aa")]
    frame = spark.createDataFrame([*rows, *((*o, "x", 0.5) for o in odd)], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert sum(got[i]["lang_pred"] == sorted(kinds)[i % 3] for i in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und"] * 4 and all(got[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert got[904]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.stage(frame)
    assert kept.columns == frame.columns and not {900, 901, 902, 903} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(frame.limit(0)).count() == 0


def test_forward_sums_all_segmentations(tmp_path):
    """The forward score equals the sum over every way to cut a word."""
    pieces = langid.vocabulary()
    model = langid.fit({"x": {"banana": 5, "band": 2, "an": 9}, "y": {"nab": 3}})
    names = {}
    import base64

    for line in open(langid.VOCABULARY, "rb"):
        raw = base64.b64decode(line.split()[0])
        data = np.frombuffer(raw, np.uint8)
        number = pieces.find(langid.span_hashes(data, np.array([0]), np.array([len(data)])))[0]
        if number:
            names[raw] = number

    def total(word, k):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            sums[j] = sum(sums[i] * model.chances[k][names[word[i:j]] - 1] for i in range(j) if word[i:j] in names)
        return math.log(sums[-1])

    words = [b"banana", b"nab", b"xyz", "né".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = langid.word_scores(data, ends - [len(w) for w in words], ends, pieces, model.chances)
    for k in range(2):
        assert np.allclose(got[k], [total(b" " + w, k) for w in words])


def test_language_ties_and_no_labels(spark):
    frame = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, lang string")
    assert langid.identify(frame).collect()[0]["lang_pred"] == "und"
    assert langid.stage(frame).count() == 1


def test_quality_ranking(spark):
    rng = np.random.default_rng(2)
    good = [syllables(1, "abcdefgh", int(rng.integers(5, 200)), rng) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in syllables(1, "abcdefgh", 40, rng).split()) for _ in range(75)] + [syllables(1, "abcdefgh", 4, rng) + " ### $$$" * 30 for _ in range(75)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*((i, t, "en") for i, t, _ in rows), (900, None, None), (901, "", "en"), (902, "x " * 50_000, "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, q, None) for i, _, q in rows), (5000, 1, None), (3, None, None)], "doc_id long, quality int, y int")
    got = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 303 and all(got[i]["held_out"] == (i in held) for i in range(300))
    assert sum(got[i]["predicted"] == (i < 150) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert {r["score"] for r in quality.report(docs.drop("score"), labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_words_scored_before_score_alike(monkeypatch):
    """Words come from what a worker has scored; beyond the bound the older half goes."""
    rng = np.random.default_rng(3)
    model = langid.fit({k: {syllables(n, "abcdefgh", 1, rng): 1 for _ in range(40)} for n, k in enumerate("xy")})
    texts = [syllables(1, "abcdefgh", int(rng.integers(0, 40)), rng) for _ in range(60)]
    pieces = langid.vocabulary()

    def totals(most):
        monkeypatch.setattr(langid, "_scored", langid.Scored(model, most))
        return np.concatenate([langid.score_batch(*text_bytes(pa.array(texts[i : i + 7])), pieces, model)[0] for i in range(0, 60, 7)], axis=1), len(langid._scored.young[0])

    whole, held = totals(1 << 20)
    some, fewer = totals(60)
    assert np.array_equal(whole, some) and held > fewer > 0
    # a further pass over the same texts scores no word anew
    monkeypatch.setattr(langid, "_scored", langid.Scored(model))
    before = langid.score_batch(*text_bytes(pa.array(texts)), pieces, model)[0]
    monkeypatch.setattr(langid, "word_scores", lambda *_: 1 / 0)
    assert np.array_equal(before, langid.score_batch(*text_bytes(pa.array(texts)), pieces, model)[0])

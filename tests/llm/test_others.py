"""Operators 1, 4, 5, 6, 9 and the pipeline: brute force, round trips, edge cases."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from corpusloom.llm import chat, extract, packing, queries, tokens, urls
from corpusloom.llm.common import scratch

# ---- op1 -------------------------------------------------------------------------


def conversations(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        roles = (["system"] if c % 5 == 0 else []) + ["user", "assistant"] * int(rng.integers(1, 4))
        for t, role in enumerate(roles):
            lines = [" ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(1, 9))) + ("?" if role == "user" else ".") for _ in range(1 if role == "user" else rng.integers(1, 5))]
            rows.append((c, t, role, "\n".join(lines)))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute_viterbi(model, found):
    shown = model.emissions(found)
    best = [(model.start + shown[0])[s] for s in range(chat.K)]
    path = [[s] for s in range(chat.K)]
    for row in shown[1:]:
        step = [max(range(chat.K), key=lambda p: (best[p] + model.move[p][s], -p)) for s in range(chat.K)]
        best, path = [best[step[s]] + model.move[step[s]][s] + row[s] for s in range(chat.K)], [path[step[s]] + [s] for s in range(chat.K)]
    return path[int(np.argmax(best))]


@pytest.mark.parametrize("block,size", [(2000, 4 << 20), (3, 4 << 20), (2000, 60)])
def test_transcripts_match_viterbi_over_whole_conversations(spark, block, size):
    raw = chat.transcripts_of(conversations(spark))
    model = chat.train(raw)
    got = defaultdict(list)
    for r in chat.parse(raw.drop("role").withColumn("a.b", raw["turn"]).withColumn("text2", raw["text"]), model, keep=("a.b", "text2"), block_rows=block, block_bytes=size).orderBy("conv_id", "turn", "part").collect():
        got[r["conv_id"]].append(r)
    table = defaultdict(list)
    for r in raw.orderBy("conv_id", "turn").collect():
        table[r["conv_id"]].append(r["text"])
    for conv, texts in table.items():
        found = [chat.features(line, k == 0)[0] for t in texts for k, line in enumerate(chat.lines_of(t))]
        states = brute_viterbi(model, found)
        want = [chat.STATES[s] for s in states]
        lines = [(r["role"], r["opens"] if k == 0 else False) for r in got[conv] for k in range(len(r["text"].split("\n")))]
        assert [w[0] for w in want] == [x[0] for x in lines]
        assert [w[1] for w in want] == [x[1] for x in lines]
        # rendered pieces in order are one canonical conversation
        whole = "".join(r["rendered"] for r in got[conv])
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == sum(r["opens"] for r in got[conv])


def test_roles_recovered_and_edges(spark):
    table = conversations(spark)
    rows = chat.report(table).collect()
    assert sum(x["role"] == x["role_given"] for x in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(None, 0, "user", None), (None, 1, "assistant", "Assistant: yes\nUser: mixed\nmore"), (1, 0, None, ""), (1, 0, "wizard", "same"), (1, 0, "wizard", "same")], table.schema)
    found = chat.report(odd)
    assert found.count() >= 5 and found.where("conv_id is null").count() >= 2
    assert chat.report(table.limit(0)).count() == 0


def test_markers():
    assert chat.features("User: hi", True)[0][0] == 2 and chat.features("### Assistant:", True)[0][0] == 3 and chat.features("<|system|> x", True)[0][0] == 1
    assert chat.features("Note: hi", True)[0][0] == 4 and chat.features("plain text", True)[0][0] == 0
    assert chat.features("**Q:** why", True) == ((2, 1, 1, 0), "why")


# ---- op4 -------------------------------------------------------------------------


def test_counts_add_up():
    encoding = tokens._encoding(tokens.RANKS)
    for text in ["", None, "a", " lead", "two  blanks", "x\n y\t z ", "don't STOP éü 한국 😀 12345 --- \n\n end", "word " * 1000]:
        assert tokens.count_tokens(text) == len(encoding.encode_ordinary(text or ""))


def test_long_texts_in_parts(monkeypatch):
    text = "".join(f"w{i}{' ' if i % 3 else '  '}" for i in range(2000))
    whole = tokens.count_tokens(text)
    monkeypatch.setattr(tokens, "_PART", 100)
    assert tokens.count_tokens(text) == whole


def test_rollup_is_idempotent_and_recovers(spark, monkeypatch):
    schema = "op string, source string, lang string, version string, n_tokens long, old_tokens long, extra string"
    one = spark.createDataFrame([("insert", "a", "en", "v", 5, None, "x"), ("insert", "a", "en", "v", 5, None, "x"), ("insert", None, None, "v", None, None, "x"), ("noise", "a", "en", "v", 99, 1, "x")], schema)
    two = spark.createDataFrame([("delete", "a", "en", "v", 5, None, "x"), ("revise", "a", "en", "v", 9, 5, "x")], schema)
    rollup = tokens.Rollup(spark, scratch(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("b/1", one) and not rollup.commit("b/1", one)
    # a commit that broke off leaves files without the marker: they don't count and are replaced
    tokens.signed(two).write.parquet(rollup._batch("two"))
    system, marker = rollup._path(rollup._batch("two") + "/_SUCCESS")
    system.delete(marker, False)
    assert {(r["source"], r["docs"], r["tokens"]) for r in rollup.totals().collect()} == {("a", 2, 10), (None, 1, 0)}
    assert rollup.commit("two", two) and rollup.commit("empty", two.limit(0)) and not rollup.commit("empty", one)
    want = {("a", 1, 9), (None, 1, 0)}
    assert {(r["source"], r["docs"], r["tokens"]) for r in rollup.totals().collect()} == want
    told = lambda: {(r["source"], r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    # broken off at each step: before the total is whole, and before a manifest names it
    for step in ("_summed", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(rollup, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                rollup.compact()
        assert told() == want and not rollup.commit("two", two)
    # a manifest that was only half written is none
    rollup._publish("manifest-000000001", '{"total": "total-')
    assert told() == want
    for _ in range(2):
        rollup.compact()
        assert told() == want and not rollup.commit("two", two) and not rollup.commit("empty", one)
    assert rollup.commit("three", one) and told() == {("a", 3, 19), (None, 2, 0)}
    rollup.compact()
    assert told() == {("a", 3, 19), (None, 2, 0)} and not rollup.commit("three", one)
    with pytest.raises(Exception):
        rollup._publish("manifest-000000002", "{}")


def test_rollup_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    frame = pd.read_parquet(f"{sf}/documents.parquet")
    frame["first"] = frame.groupby("text")["doc_id"].transform("min")
    kept = frame[frame["doc_id"] == frame["first"]]
    want = defaultdict(lambda: [0, 0])
    for r in kept.itertuples():
        for version, n in (("words-1", sum(any(c.isalnum() for c in w) for w in r.text.split())), (tokens.version(), tokens.count_tokens(r.text))):
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    got = {(r["source"], r["lang"], r["version"]): [r["docs"], r["tokens"]] for r in queries.op4_token_rollup(spark, sf).collect()}
    assert got == dict(want)


# ---- op5 -------------------------------------------------------------------------


def day(n):
    return dt.date(2024, 1, n)


def test_url_lists(spark):
    entries = [
        ("l1", "block", "add", "d:bad.com", day(5)), ("l1", "block", "remove", "d:bad.com", day(9)), ("l2", "block", "add", "d:bad.com", day(12)),
        ("l1", "allow", "add", "p:www.bad.com/ok", day(1)), ("l1", "block", "add", "d:same.com", day(3)), ("l1", "block", "remove", "d:same.com", day(3)),
        ("l3", "block", "add", None, day(1)), ("l3", "block", "add", "d:x.com", None), ("l3", "odd", "add", "d:y.com", day(1)),
    ]
    cases = [
        ("http://bad.com/", day(4), False), ("http://bad.com/", day(5), True), ("https://u@WWW.Bad.com.:80/ok/page?q#f", day(6), False), ("https://www.bad.com/okay", day(6), True),
        ("http://bad.com", day(9), False), ("http://a.b.bad.com/x", day(12), True), ("http://notbad.com/", day(6), False), ("http://same.com/", day(4), False),
        (None, day(6), False), ("not a url", day(6), False), ("http://bad.com/", None, False), ("http://y.com/", day(6), False), ("http://bad.com/", day(5), True),
    ]
    captures = spark.createDataFrame([(i, u, t, True) for i, (u, t, _) in enumerate(cases)], "page_id long, url string, fetched_at date, blocked boolean")
    listed = spark.createDataFrame(entries, "list string, verdict string, action string, key string, at date")
    got = {r["page_id"]: r["blocked"] for r in urls.evaluate(captures, listed, ("page_id",)).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(cases)}
    clash = captures.withColumnRenamed("page_id", "row.x").withColumn("key", captures["url"]).withColumn("list", captures["url"])
    assert urls.evaluate(clash, listed, ("row.x", "key")).columns[:2] == ["row.x", "key"]
    assert urls.evaluate(captures.limit(0), listed, ("page_id",)).count() == 0
    assert not [r for r in urls.evaluate(captures, listed.limit(0), ("page_id",)).collect() if r["blocked"]]


def test_a_list_ends_only_its_own_entries(spark):
    entries = [("a", "block", "add", "d:x.com", day(1)), ("b", "block", "add", "d:x.com", day(3)), ("a", "block", "remove", "d:x.com", day(5)), (None, "block", "add", "d:x.com", day(7)), ("b", "block", "remove", "d:x.com", day(9))]
    listed = spark.createDataFrame(entries, "list string, verdict string, action string, key string, at date")
    captures = spark.createDataFrame([(n, "http://x.com/", day(n)) for n in range(1, 11)], "page_id long, url string, fetched_at date")
    got = {r["page_id"]: (r["blocked"], r["n_active"], r["list"]) for r in urls.evaluate(captures, listed, ("page_id",)).collect()}
    assert [got[n][1] for n in range(1, 11)] == [1, 1, 2, 2, 1, 1, 2, 2, 1, 1] and all(b for b, _, _ in got.values())
    assert got[3][2] == got[8][2] == "b" and got[10][2] is None


def test_url_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(str, con.execute(queries.URL_SQL).fetchall())) == sorted(str(tuple(r)) for r in queries.op5_url_lists(spark, sf).collect())


# ---- op6 -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><style>p{{}}</style><script>var t="</p><article>no";</script></head><body>
<header class="site-header"><h2>Site {n}</h2></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- c -->
<div class="cookie-notice">cookies</div><aside id="sidebar">side</aside><div class="ad">advert {n}</div>
<{tag}><h1>Title {n} &amp; more</h1>{body}<section class="comments"><p>a comment</p></section><form><p>form</p></form></{tag}>
<footer>&copy; all rights</footer>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"', 'div id="x7"'])
def test_wrappers(spark, tag):
    rows, want = [], {}
    for n in range(12):
        paragraphs = [f"Paragraph {n} {k} says   something\n of length {k * n} &lt;here&gt; " + "word " * (30 + 7 * k) for k in range(1 + n % 4)]
        html = PAGE.format(n=n, tag=tag, body="".join(f"<p><b>{p}<br>" if k == 0 else f"<p>{p}</p>" for k, p in enumerate(paragraphs))).replace(f"</{tag}>", f"</{tag.split()[0]}>")
        rows.append((n, f"http://h{n % 2}.com/p/{n}", html, "extra"))
        want[n] = "\n".join([f"Title {n} & more", *(" ".join(p.replace("&lt;", "<").replace("&gt;", ">").split()) for p in paragraphs)])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.report(frame).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_extract_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.com/", "plain text"), (4, "http://b.com/", "<p>one<p>two &amp; 3 < 4<div>three"), (5, "http://b.com/", "<" * 50), (6, "http://c.com", "<div>" * 3000 + "deep"), (7, "http://d.com/", "<article><p>a</p></article>"), (7, "http://d.com/", "<article><p>a</p></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(list)
    for r in extract.report(frame).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == [""] and got[2] == [""] and got[3] == ["plain text"] and got[4] == ["one\ntwo & 3 < 4\nthree"] and got[6] == ["deep"] and got[7] == ["a", "a"]
    assert extract.report(frame.limit(0)).count() == 0


def test_alignment_of_wrappers():
    a = extract.folded(extract.parse("<div><h1>A</h1><p>x</p><p>y</p></div>"))
    b = extract.folded(extract.parse("<div><h1>B</h1><i>z</i><table><tr><td>1</td></tr></table><p>x</p></div>"))
    div = extract.aligned(a, b)[extract.CHILDREN][0]
    shape = [(c[extract.S], len(c[extract.TEXTS]), c[extract.OPTIONAL], c[extract.REPEATED], c[extract.PAGES]) for c in div[extract.CHILDREN]]
    assert shape == [("h1", 2, False, False, 2), ("i", 1, True, False, 1), ("table", 0, True, False, 1), ("p", 2, False, True, 2)]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_hot_hosts_and_small_ones_read_alike(spark, monkeypatch, limit):
    """Rules that are broadcast and rules that are joined, with hosts dealt over tasks."""
    monkeypatch.setattr(extract, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(extract, "HOT_PAGES", 7)
    rows = [(n, None if n % 40 == 39 else f"http://{'hot' if n % 4 else 'h%d' % (n % 3)}.org/{n}", f"<body><div class=m>All the same</div><div class=t><p>Text {n} " + "word " * 30 + "</p></div></body>", 1) for n in range(80)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, `k0.x` long")
    monkeypatch.setattr(extract.wrappers, "__defaults__", ("html", 2))
    got = {r["page_id"]: r["text"] for r in extract.report(frame.repartition(9)).collect()}
    assert got == {n: f"Text {n} " + " ".join(["word"] * 30) for n in range(80)}
    assert extract.extract(frame, keep=("k0.x",)).columns == ["k0.x", "text"]


def test_page_texts_equal_their_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = dict(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    import re

    for r in queries.op6_html_wrappers(spark, sf).collect():
        doc = int(re.search(r"://[^/]+/\w+/(\d+)", r["url"])[1])
        assert r["text"].split("\n")[1:] == [" ".join(x.split()) for x in docs[doc].split("\n") if x.strip()]


# ---- op9 -------------------------------------------------------------------------


def test_packing_places_everything_once(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.lognormal(6, 1.2, 700)] + [0, None, 8192, 8193, 50_000, 1, 1, 512]
    frame = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)] + [(1, lengths[1], "x")], "doc_id long, n_tokens long, bin string")
    rows = packing.packed(frame, shard_rows=200).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        total[r["doc_id"]] += r["part_tokens"]
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
    assert all(total[i] == (n or 0) * (2 if i == 1 else 1) for i, n in enumerate(lengths))
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        end = 0
        for r in held:
            assert r["offset"] == end
            end += r["part_tokens"]
        size = held[0]["bin_size"]
        assert size in packing.SIZES and end <= size and not any(end <= c and packing.cost(c) < packing.cost(size) for c in packing.SIZES)
    assert packing.packed(frame.limit(0)).count() == 0


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(7)
    sizes = [16, 32, 64]
    for _ in range(50):
        lengths = sorted((int(x) for x in rng.integers(1, 65, rng.integers(0, 60))), reverse=True)
        bins, offsets, final = packing.pack(lengths, sizes)
        rate = sorted(sizes, key=lambda c: (packing.cost(c) / c, c))
        room, used = [], []
        for n, b, o in zip(lengths, bins, offsets):
            fits = [x for x in room if x >= n]
            if fits:
                assert room[b] == min(fits)
            else:
                assert b == len(room)
                room.append(next(c for c in rate if c >= n))
                used.append(0)
            assert o == used[b]
            room[b] -= n
            used[b] += n
        assert all(u <= f for u, f in zip(used, final))


# ---- pipeline --------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage keeps what its operator, asked alone, would keep, and the last one
    places every token of what is left."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    left = {r["doc_id"]: tokens.count_tokens(r["text"]) for r in docs.collect()}
    total = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        total[r["doc_id"]] += r["part_tokens"]
    assert dict(total) == left and 0 < len(left) < 200


def test_stages_on_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0

"""Search, resolve, gap (A02-A08) on small corpora and against SQLite's full-text index."""

from __future__ import annotations

import sqlite3

import pytest

from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators.corpus import DOCUMENT, Settings, alias_map, build, classify_scopes, dedupe, scope_table


def record(n, name, body="", *, aliases=(), requires=(), recommends=(), path=None, mtime=1.0, title=None, category="custom", root="/r", description="", keywords=(), tags=()):
    return (n, name, name, path or f"{root}/{name}/SKILL.md", root, None, title or name, category, description, list(keywords), list(tags), list(aliases), list(requires), list(recommends), body, None, float(mtime))


def corpus(spark, *records, **settings):
    return build(spark.createDataFrame(list(records), DOCUMENT), Settings(**settings))


def names(hits):
    return [r["canonical_name"] for r in hits.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def small(spark):
    c = corpus(
        spark,
        record(0, "alpha", "security review coverage metrics ranking", aliases=["reading-list"], requires=["beta"]),
        record(1, "beta", "documentation templates and café notes", aliases=["docs"]),
        record(2, "gamma", "runtime metrics and indexing diagnostics", recommends=["alpha", "nobody"]),
        record(3, "cartographers", "tracing of services"),
        record(4, "delta", "cartographers is mentioned here once"),
        record(5, "korean", "자연어처리 도서목록 정리"),
    )
    return c, I.build_index(c.documents)


def test_bm25_equals_full_text_search(small):
    c, index = small
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, a, b, c, d, e, f, g, h, tokenize = \"unicode61 tokenchars '_'\")")
    for d in c.documents.collect():
        fields = [d["canonical_name"], " ".join(d["aliases"]), d["title"], d["description"], d["category"], " ".join(d["keywords"]), " ".join(d["tags"]), d["body_text"]]
        frame = c.spark.createDataFrame([(f,) for f in fields], "v string")
        from corpusloom.functions.text import document_tokens
        from pyspark.sql import functions as F

        con.execute("insert into t values (?, ?, ?, ?, ?, ?, ?, ?, ?)", (d["skill_id"], *(" ".join(r["t"]) for r in frame.select(document_tokens(F.col("v")).alias("t")).collect())))
    for term in ("metrics", "cartographers", "alpha", "cafe", "custom", "diagnostics"):
        want = dict(con.execute("select id, -bm25(t, 0, 3.0, 2.6, 2.2, 2.0, 1.4, 1.2, 1.1, 1.0) from t where t match ?", (f'"{term}"',)).fetchall())
        got = {r["skill_id"]: r["score"] for r in S.score(index, [S.Variant(0, term, term, "base", 1.0)]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_title_and_typo_and_prefix(small):
    c, index = small
    exact = S.ranked(c, index, "cartographers", 5)
    assert names(exact) == ["cartographers", "delta"]
    typo = S.ranked(c, index, "cartogrphers", 5)
    assert names(typo)[0] == "cartographers" and typo.first()["score"] < exact.orderBy("rank").first()["score"]
    assert names(S.ranked(c, index, "cart", 5))[0] == "cartographers"
    assert names(S.ranked(c, index, "Planex", 5)) == []


def test_diacritics_and_korean(small):
    c, index = small
    assert names(S.ranked(c, index, "cafe", 5)) == ["beta"] and names(S.ranked(c, index, "café", 5)) == []
    assert names(S.ranked(c, index, "자연어처리합니다", 5)) == ["korean"]


def test_ties_scores_and_limits(spark):
    c = corpus(spark, record(0, "zeta-alpha", "word"), record(1, "alpha-zeta", "word"), record(2, "other", "nothing"))
    index = I.build_index(c.documents)
    rows = S.ranked(c, index, "alpha", 5).orderBy("rank").collect()
    assert [r["canonical_name"] for r in rows] == ["alpha-zeta", "zeta-alpha"] and rows[0]["score"] == rows[1]["score"]
    assert names(S.ranked(c, index, "alpha", 1)) == ["alpha-zeta"]
    assert names(S.ranked(c, index, "alpha", 5, rows[0]["score"] + 1e-4)) == []
    assert names(S.ranked(c, index, "", 5)) == [] and names(S.ranked(c, index, None, 5)) == []


def test_fallback_and_diagnostics(small):
    c, index = small
    found = S.search(c, index, "report zzzz metrics", 5)
    assert found.mode == "none"
    found = S.search(c, index, "qqqq usefulness", 5)
    assert found.mode == "query-rewrite" and found.query == "skill registry diagnostics" and names(found.hits) == ["gamma"]
    assert S.search(c, index, "qqqq", 5).mode == "safe-zero"
    assert S.search(c, index, "reading list of alpha", 5).aliases == ["reading-list"]


def test_scope_ties(spark):
    rows = [record(i, f"n{i}", "same words", root=f"/{s}") for i, s in enumerate("abc")]
    roots = {"a": ["/a"], "b": ["/b"], "c": ["/c"]}
    for order in (["a", "b", "c"], ["c", "b", "a"]):
        c = corpus(spark, *rows, scope_priority=order, scope_roots=roots)
        got = S.ranked(c, I.build_index(c.documents), "words", 5).orderBy("rank").collect()
        assert [r["scope"] for r in got] == order


def test_resolve(small):
    c, index = small
    out = S.resolve(c, index, ["reading-list", "beta", "alpha", "gama", "x" * 10_000], True, 60, 1000)
    rows = out["resolved"].orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["alpha", "beta"] and [r["omitted_by_budget"] for r in rows] == [False, True] and rows[1]["body"] is None
    assert [r["requested"] for r in out["missing"].orderBy("pos").collect()] == ["gama", "x" * 10_000]
    near = S.resolve(c, index, ["cartogrphers"], False, 0, 0)["suggestions"].collect()
    assert [(r["name"], r["confidence"]) for r in near] == [("cartographers", 0.923)]


def test_budget_fold_skips_and_goes_on(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("a", 1, "xxxx"), ("b", 2, "xxxxxxxx"), ("c", 3, "xx"), ("d", 4, ""), ("e", 5, None)], "name string, o int, body string")
    got = {r["name"]: r["included"] for r in S.budget_fold(frame, [F.col("o")], "body", 6).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": None, "e": None}
    assert all(r["included"] is not False for r in S.budget_fold(frame, [F.col("o")], "body", 0).collect())
    assert S.effective_chars(100, 10) == 40 and S.effective_chars(0, 10) == 40 and S.effective_chars(100, 0) == 100


def test_gap(small):
    c, index = small
    row = S.gap(c, index, "metrics zzyzx", [], 0.7, 5)["gap"].first()
    assert row["covered_terms"] == ["metrics"] and row["uncovered_terms"] == ["zzyzx"] and row["recommended_action"] == "add-alias" and row["scaffold"]["name"] == "metrics-zzyzx"
    assert S.gap(c, index, "metrics", [], 0.7, 5)["gap"].first()["recommended_action"] == "use-existing"
    assert S.gap(c, index, "zzyzx", [], 0.7, 5)["gap"].first()["recommended_action"] == "create-skill"
    assert S.gap(c, index, "metrics", ["beta"], 0.7, 5)["gap"].first()["candidates"] == 0


def test_dedupe_and_log(spark):
    rows = [record(0, "x", path="/b/x", mtime=1), record(1, "x", path="/a/x", mtime=1), record(2, "x", path="/c/x", mtime=5), record(3, "y")]
    for flip in (False, True):
        d = spark.createDataFrame([(9 - r[0] if flip else r[0], *r[1:]) for r in rows], DOCUMENT)
        winners, log = dedupe(d, [])
        assert {(r["canonical_name"], r["path"]) for r in winners.collect()} == {("x", "/c/x"), ("y", "/r/y/SKILL.md")}
        assert log.count() == 2
    log = dedupe(spark.createDataFrame(rows, DOCUMENT), [])[1]
    assert sorted((r["kept_path"], r["dropped_path"]) for r in log.collect()) == [("/a/x", "/b/x"), ("/c/x", "/a/x")]


def test_alias_owner(spark):
    d = spark.createDataFrame([record(0, "x", aliases=["s", "y"], mtime=9), record(1, "y", mtime=1), record(2, "z", aliases=["s"], mtime=3)], DOCUMENT)
    owner, log = alias_map(d, [])
    assert {r["alias"]: r["canonical_name"] for r in owner.collect()} == {"x": "x", "y": "x", "z": "z", "s": "x"}
    assert {(r["alias"], r["canonical_name"], r["conflicting_canonical_name"]) for r in log.collect()} == {("s", "x", "z"), ("y", "x", "y")}


def test_scopes_at_slashes(spark):
    d = spark.createDataFrame([(p,) for p in ("/skills/a", "/skills-extra/a", "/skills/in/b", "/skills", "/else")], "path string")
    roots = scope_table(spark, {"top": ["/skills/"], "in": ["/skills/in"]})
    got = {r["path"]: r["scope"] for r in classify_scopes(d, roots, fallback="unclassified").collect()}
    assert got == {"/skills/a": "top", "/skills-extra/a": "unclassified", "/skills/in/b": "in", "/skills": "top", "/else": "unclassified"}


def test_bounded_text():
    assert S.bounded_text("é" * 5000, 4096) == "é" * 2048 and len(S.bounded_text("a " * 5000).split()) == 1024

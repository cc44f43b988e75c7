from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from tests.test_search import record


def documents(spark, seed=3, n=120):
    rng = random.Random(seed)
    rows = [record(k, rng.choice(["hot"] * 6 + [f"n{i}" for i in range(30)]), f"body {k}", aliases=[rng.choice(["all", f"a{rng.randrange(9)}"])], mtime=float(rng.randrange(5)), root=rng.choice(["/a", "/b"])) for k in range(n)]
    d = spark.createDataFrame(rows, C.DOCUMENT).withColumn("path", F.concat("path", F.lit("/"), F.col("ordinal").cast("string")))
    return d.withColumn("scope", C.scope_of(F.col("path"), {"one": ["/b"], "two": ["/a", "/b"]}, "none"))


def plain(frame, *columns):
    return sorted(tuple(r[c] for c in columns or frame.columns) for r in frame.collect())


def test_winners_and_logs_however_names_are_cut(spark):
    d = documents(spark)
    rows = sorted(d.select("ordinal", "canonical_name", "path", "scope", "mtime_ms").collect(), key=lambda r: (r["ordinal"], r["path"]))
    key = lambda r: (["one", "two", "none"].index(r["scope"]), -r["mtime_ms"], r["path"])
    best, first, log = {}, {}, []
    for r in rows:
        held = best.get(r["canonical_name"])
        first.setdefault(r["canonical_name"], r["ordinal"])
        if held is None or key(r) < key(held):
            best[r["canonical_name"]] = r
        if held is not None:
            kept = best[r["canonical_name"]]
            log.append((r["canonical_name"], kept["path"], (held if kept is r else r)["path"]))
    want = sorted((name, r["path"], first[name]) for name, r in best.items())
    for most in (C.HOT, 3):
        winners, found = C.dedupe(d, ["one", "two"], most)
        assert plain(winners, "canonical_name", "path", "ordinal") == want
        assert plain(found) == sorted(log)


def test_alias_owners_however_aliases_are_cut(spark):
    d = C.dedupe(documents(spark), ["one", "two"])[0]
    near, far = C.alias_map(d, ["one", "two"]), C.alias_map(d, ["one", "two"], 2)
    assert plain(near[0]) == plain(far[0]) and plain(near[1]) == plain(far[1]) and near[1].count() > 5


def test_the_same_document_twice(spark):
    d = documents(spark, n=8)
    winners, _ = C.dedupe(d.unionByName(d), ["one", "two"])
    assert plain(winners, "canonical_name", "path") == plain(C.dedupe(d, ["one", "two"])[0], "canonical_name", "path")


def test_no_body_is_shuffled(spark):
    built = C.build(documents(spark).drop("scope").withColumn("scope", F.lit(None).cast("string")), C.Settings(scope_roots={"one": ["/a"]}))
    plan = built.documents._jdf.queryExecution().executedPlan().toString()
    body = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not body, body


def test_scopes_as_an_expression_equal_the_join(spark):
    roots = {"first": ["/x", "/y/z/"], "second": ["/x/deep", "/x"], "rest": ["/"]}
    paths = spark.createDataFrame([(p,) for p in ("/x/a", "/x/deep/b", "/x/deeper", "/y", "/y/z", "/y/z/q/", "/other", "x")], "path string")
    want = C.classify_scopes(paths, C.scope_table(spark, roots), fallback="none")
    got = paths.withColumn("scope", C.scope_of(F.col("path"), roots, "none"))
    assert plain(got, "path", "scope") == plain(want, "path", "scope")

"""Faults that were found once, each as it was shown."""

from __future__ import annotations

import json
import shutil

import duckdb
from pyspark.sql import functions as F

from corpusloom.operators import decide as D
from corpusloom.operators import graph as G
from corpusloom.operators import hooks, tables
from corpusloom.plans import queries, render
from corpusloom.plans.engine import Result
from corpusloom.sources.settings import Settings
from corpusloom.sources.snapshot import Store
from corpusloom.streaming import incremental
from tests.test_search import corpus, record


def test_documents_without_a_time_are_indexed(spark, tmp_path):
    docs = corpus(spark, *(record(k, f"d{k}", f"word{k}") for k in range(4))).documents
    docs = docs.withColumn("mtime_ms", F.when(F.col("canonical_name") < "d2", F.col("mtime_ms")))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert incremental.current(spark, str(tmp_path / "out")).select("skill_id").distinct().count() == 4


def test_queries_after_clear_and_after_a_change(spark, tmp_path):
    for name in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    folder = str(tmp_path)
    before = queries.orphans(spark, folder).count()
    tables.clear(spark)
    assert queries.orphans(spark, folder).count() == before > 0
    duckdb.sql(f"COPY (FROM '{tmp_path}/documents.parquet' WHERE doc_id < 50) TO '{tmp_path}/less.parquet' (FORMAT parquet)")
    (tmp_path / "less.parquet").replace(tmp_path / "documents.parquet")
    assert queries._corpus(spark, folder).documents.count() == 50


def test_text_tells_the_whole_number(spark):
    many = spark.range(450).select((F.col("id") + 1).alias("place"), F.lit("error").alias("severity"), F.lit("x").alias("kind"), F.lit("m").alias("message"), F.lit("s").alias("skill_name"), F.lit("p").alias("path"))
    text = render.text_of("audit", {"issues": many}, {"ok": False})
    assert text.startswith("audit: 450\n") and f"shown: the first {render.SHOWN}, {450 - render.SHOWN} more are not" in text
    few = render.text_of("audit", {"issues": many.where("place <= 3")}, {})
    assert few.startswith("audit: 3\n") and "shown" not in few


def test_error_of_a_lazy_frame_is_told(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("no such row")).cast("long").alias("place"))
    assert Result("audit", {"issues": broken}).text().startswith("error: audit failed")


def test_malformed_payload_is_null(spark):
    texts = spark.createDataFrame([("{", 1), (json.dumps({"prompt": "x"}), 2), (None, 3), ("[" * 100_000, 4)], "t string, n int")
    assert {r["x"] for r in texts.select(hooks.rewrite_payload_json(F.col("t")).alias("x")).collect()} == {None}


def test_frames_and_token_are_of_one_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "snap"))
    store.save(corpus(spark, record(0, "old", "one")), {}, "s", now_ms=1000)
    facts, read = store.facts(), store.facts

    def then_another():
        monkeypatch.setattr(store, "facts", read)
        store.save(corpus(spark, record(0, "new", "two")), {}, "s", now_ms=1001)
        return facts

    monkeypatch.setattr(store, "facts", then_another)
    held, _, token = store.load({}, Settings(), "s", now_ms=1002)
    assert token == facts["token"] and [r["canonical_name"] for r in held.documents.collect()] == ["old"]


def test_decisions_of_any_width_have_the_same_ranks(spark):
    c = corpus(spark, *(record(k, f"n{k:02}", "w", requires=[f"n{(k * 7) % 40:02}"], recommends=["n03"]) for k in range(40))).materialised()
    pool = D.candidates(c, None, None, [f"n{k:02}" for k in range(40)], 50)
    near, far = D.decide(c, pool, 50), D.decide(c, pool, 50, top=0)
    assert near.dtypes == far.dtypes
    got = [sorted(map(str, x.select("rank", "name", "score", "reasons").collect())) for x in (near, far)]
    assert got[0] == got[1] and len(got[0]) == 40
    assert [r["rank"] for r in D.decide(c, pool, 7, top=0).orderBy("rank").collect()] == list(range(1, 8))


def test_composition_of_requirements_in_both_forms(spark):
    c = corpus(spark, *(record(k, f"n{k:02}", "w", requires=[f"n{(k * 3 + 1) % 30:02}", f"n{(k * 5) % 30:02}", f"gone{k % 4}"]) for k in range(30))).materialised()
    e = G.edges(c)
    for seeds in (["n04"], ["n07", "n00"]):
        near, far = G.compose(c, e, seeds, False), G.compose(c, e, seeds, False, local_edges=0)
        for a, b in zip(near, far, strict=True):
            assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))

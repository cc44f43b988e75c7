from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators.ranks import numbered


def test_places_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = numbered(df, ["v", "i"], ["g"], total="n").collect()
        found = {r["i"]: r["place"] for r in ranked}
        whole = {r["i"]: r["at"] for r in numbered(df, [F.col("v").desc(), "i"], column="at", first=0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "a", "b", None):
        ordered = sorted((v, i) for h, v, i in rows if h == g)
        assert [found[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
        assert {r["n"] for r in ranked if r["g"] == g} == {len(ordered)}
    ordered = sorted((-v, i) for _, v, i in rows)
    assert [whole[i] for _, i in ordered] == list(range(len(rows)))


def test_places_of_nothing_and_of_equal_rows(spark):
    none = spark.createDataFrame([], "g string, v long")
    assert numbered(none, ["v"], ["g"]).collect() == [] and numbered(none, ["v"]).columns == ["g", "v", "place"]
    same = spark.createDataFrame([("x", 1)] * 50, "g string, v long").repartition(5)
    assert sorted(r["place"] for r in numbered(same, ["v"], ["g"]).collect()) == list(range(1, 51))

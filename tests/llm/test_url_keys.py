from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.llm import urls


def test_unlisted_keys_drop_out_before_the_join(spark):
    valid = spark.createDataFrame([(f"d:h{k}.example",) for k in range(0, 3000, 3)], "key string")
    keyed = spark.createDataFrame([(k, f"d:h{k}.example") for k in range(3000)] + [(-1, "d:com")] * 50, "row long, key string")
    left = {r["key"] for r in urls.maybe_listed(keyed, valid, 0).collect()}
    listed = {r["key"] for r in valid.collect()}
    assert listed <= left and len(left - listed) < 400
    assert urls.maybe_listed(keyed, valid).count() == keyed.count()
    assert urls.maybe_listed(keyed, valid.limit(0), -1).count() == 0


def test_results_are_the_same_with_and_without_the_bitmap(spark):
    rng = random.Random(4)
    hosts = [f"{a}.{b}.com" for a in "abcdef" for b in ("x", "y", "z")]
    entries = spark.createDataFrame([(f"l{rng.randrange(3)}", rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), f"d:{rng.choice(hosts)}", f"2024-01-{rng.randint(1, 28):02}") for _ in range(60)], "list string, verdict string, action string, key string, at string").withColumn("at", F.to_date("at"))
    captures = spark.createDataFrame([(k, f"http://{rng.choice(hosts)}/p{k % 3}/q" if k % 17 else None, f"2024-01-{rng.randint(1, 28):02}") for k in range(400)], "n long, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at"))
    near, far = (sorted(map(str, urls.evaluate(captures, entries, ("n", "url"), few_keys=k).collect())) for k in (urls.FEW_KEYS, 0))
    assert near == far and any("blocked=True" in r for r in near)

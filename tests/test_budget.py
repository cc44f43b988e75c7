from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import budget as B


def brute(sizes, budget):
    used, out = 0, []
    for n in sizes:
        fits = budget <= 0 or used + n <= budget
        out.append(fits if n else None)
        used += n if n and fits else 0
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1 << 16), (2, 7), (3, 3)])
def test_fold_equals_the_sequential_one(spark, seed, chunk):
    rng = random.Random(seed)
    for budget in (0, 1, rng.randrange(2, 50), rng.randrange(100, 4000)):
        most = rng.choice([3, 40, 900, 3000])
        sizes = [rng.choice([0, 1, rng.randrange(most), rng.randrange(most)]) for _ in range(rng.randrange(1, 120))]
        rows = spark.createDataFrame([(k + 1, n) for k, n in enumerate(sizes)], "place long, n long").repartition(3)
        found = {r["place"]: r["included"] for r in B.fold(rows, budget, chunk).collect()}
        assert [found[k + 1] for k in range(len(sizes))] == brute(sizes, budget), (budget, sizes)


def test_passes_grow_with_the_logarithm(spark, monkeypatch):
    """Each misfit takes away one: a fold by misfits would need a thousand passes."""
    sizes = [x for k in range(1000) for x in (1, 1000 - k)]
    calls, event = [], B._event
    monkeypatch.setattr(B, "_event", lambda *a: calls.append(1) or event(*a))
    rows = spark.createDataFrame([(k + 1, n) for k, n in enumerate(sizes)], "place long, n long")
    found = {r["place"]: r["included"] for r in B.fold(rows, 1000).collect()}
    assert [found[k + 1] for k in range(len(sizes))] == brute(sizes, 1000) and len(calls) <= 11


def test_budget_of_bodies(spark):
    rows = spark.createDataFrame([("b", "xx"), ("a", "yyyy"), ("c", None), ("d", "z")], "name string, body string")
    found = {r["name"]: (r["place"], r["included"]) for r in B.budget_fold(rows, [F.col("name")], "body", 5).collect()}
    assert found == {"a": (1, True), "b": (2, False), "c": (3, None), "d": (4, True)}
    assert B.budget_fold(rows.limit(0), [F.col("name")], "body", 5).collect() == []

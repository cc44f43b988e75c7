from __future__ import annotations

import random

import pytest

from corpusloom.operators import graph as G
from corpusloom.operators import walk as W
from corpusloom.operators.walk import walk


def graphs(seed, count):
    """Random relations of ``count`` graphs with names of their own, and their seeds."""
    rng = random.Random(seed)
    rows, seeds = [], []
    for g in range(count):
        n = rng.choice([2, 5, 9, 14])
        names = [f"g{g}-{rng.choice('abXé')}{i}" for i in range(n)]
        for u in names:
            for relation, most in (("requires", rng.choice([0, 1, 1, 2])), ("recommends", rng.choice([0, 1, 2, 4]))):
                for pos in range(rng.randint(0, most)):
                    to = rng.choice(names) if rng.random() < 0.9 else None
                    rows.append((u, to or f"g{g}-lost{rng.randrange(3)}", to, relation, to is not None, pos))
        seeds += rng.sample(names, rng.choice([1, 1, 2]))
    return rows, seeds


@pytest.mark.parametrize(("seed", "most_places"), [(1, 1 << 60), (2, 2000)])
def test_walk_is_the_queue(spark, seed, most_places):
    rows, seeds = graphs(seed, 200)
    edges = spark.createDataFrame(rows, "from_name string, target string, to_name string, relation string, resolved boolean, pos int").repartition(3)
    out = {}
    for u, target, to, relation, _, pos in sorted(rows, key=lambda r: (r[3] != "requires", r[5])):
        out.setdefault(u, []).append((target, to, "required" if relation == "requires" else "recommended"))
    best, missing = G.compose_of(seeds, lambda n: out.get(n, []))
    entries, gaps = walk(edges, seeds, most_places)
    assert {r["name"]: (r["reason"], r["depth"], r["via"]) for r in entries.collect()} == best
    assert {(r["relation"], r["name"], r["via"], r["depth"]) for r in gaps.collect()} == missing
    assert entries.count() == len(best) > 400


def test_chain_of_doubts(spark):
    """Each of a generation's documents requires the next one: every second is passed over."""
    n = 12
    rows = [("s", f"r{i:02}", f"r{i:02}", "recommends", True, i) for i in range(n)]
    rows += [(f"r{i:02}", f"r{i + 1:02}", f"r{i + 1:02}", "requires", True, 0) for i in range(n - 1)]
    edges = spark.createDataFrame(rows, "from_name string, target string, to_name string, relation string, resolved boolean, pos int")
    out = {}
    for u, target, to, relation, _, _ in rows:
        out.setdefault(u, []).append((target, to, "required" if relation == "requires" else "recommended"))
    best, _ = G.compose_of(["s"], lambda k: out.get(k, []))
    assert {r["name"]: (r["reason"], r["depth"], r["via"]) for r in walk(edges, ["s"])[0].collect()} == best


def test_no_seeds_and_no_relations(spark):
    none = spark.createDataFrame([], "from_name string, target string, to_name string, relation string, resolved boolean, pos int")
    assert walk(none, [])[0].collect() == [] and [tuple(r) for r in walk(none, ["x"])[0].collect()] == [("x", "seed", 0, None)]


def test_second_openings_offer_nothing(spark, monkeypatch):
    """What is required after it was recommended is opened again, and its missing relations
    are met again, but its offers aren't made twice."""
    rows = [("s", "a", "a", "recommends", True, 0), ("s", "b", "b", "requires", True, 0), ("b", "c", "c", "requires", True, 0), ("c", "a", "a", "requires", True, 0)]
    rows += [("a", f"x{i}", f"x{i}", "recommends", True, i) for i in range(5)] + [("a", "lost", None, "requires", False, 0)]
    edges = spark.createDataFrame(rows, "from_name string, target string, to_name string, relation string, resolved boolean, pos int")
    offers = []

    def kept(df, name, keep=W.written):
        out = keep(df, name)
        offers.extend([out] if name == "offers" else [])
        return out

    monkeypatch.setattr(W, "written", kept)
    entries, gaps = walk(edges, ["s"])
    assert {r["name"]: (r["reason"], r["depth"], r["via"]) for r in entries.collect()}["a"] == ("required", 3, "c")
    assert sorted(tuple(r) for r in gaps.collect()) == [("lost", "required", "a", 2), ("lost", "required", "a", 4)]
    assert sum(o.count() for o in offers) == 9


@pytest.mark.parametrize("seed", [3, 4])
def test_large_fronts_are_shuffled_and_give_the_same(spark, monkeypatch, seed):
    rows, seeds = graphs(seed, 60)
    edges = spark.createDataFrame(rows, "from_name string, target string, to_name string, relation string, resolved boolean, pos int")
    few = walk(edges, seeds)
    monkeypatch.setattr(W, "FEW", 0)
    many = walk(edges, seeds)
    for a, b in zip(few, many, strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)

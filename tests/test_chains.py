from __future__ import annotations

import random

import pytest

from corpusloom.operators import chains
from corpusloom.operators import graph as G


def graphs(seed, count):
    """Random graphs with long paths, side by side: nodes and arcs."""
    rng = random.Random(seed)
    nodes, pairs = [], set()
    for g in range(count):
        n = rng.choice([1, 2, 6, 15, 40])
        own = [f"g{g}-{rng.randrange(1000)}-{i}" for i in range(n)]
        nodes += own
        for a, b in zip(own, own[1:], strict=False):
            if rng.random() < 0.85:
                pairs.add((a, b))
        for _ in range(rng.choice([0, 1, 2, n // 2])):
            pairs.add((rng.choice(own), rng.choice(own)))
        if rng.random() < 0.2:
            pairs.add((own[-1], own[0]))
    return nodes, sorted(pairs)


@pytest.mark.parametrize("seed", [1])
def test_distributed_components_and_layers(spark, seed):
    nodes, pairs = graphs(seed, 120)
    node, arc = spark.createDataFrame([(n,) for n in nodes], "name string"), spark.createDataFrame(pairs, "u string, v string").repartition(3)
    root = G.components_of(nodes, pairs)
    assert {r["name"]: r["root"] for r in G.strong_components(node, arc, 0).collect()} == root
    read, apply = G.levels_of(root, pairs)
    found = {r["name"]: (r["root"], r["read_layer"], r["apply_layer"]) for r in G.layers(node, arc, 0).collect()}
    assert found == {n: (root[n], read[n], apply[n]) for n in nodes}


def test_rounds_of_long_paths_and_rings(spark, monkeypatch):
    n, rounds, keep = 10_000, [], chains.written
    monkeypatch.setattr(chains, "written", lambda df, name: rounds.append(name) or keep(df, name))
    monkeypatch.setattr(G, "written", lambda df, name: rounds.append(name) or keep(df, name))
    ring = spark.range(n).selectExpr("concat('r', lpad(id, 5, '0')) u", f"concat('r', lpad((id + 1) % {n}, 5, '0')) v")
    path = spark.range(n - 1).selectExpr("concat('p', lpad(id, 5, '0')) u", "concat('p', lpad(id + 1, 5, '0')) v")
    both = ring.unionByName(path)
    nodes = both.selectExpr("explode(array(u, v)) name").distinct()
    found = G.strong_components(nodes, both, 0).groupBy("root").count().groupBy("count").count().collect()
    assert {tuple(r) for r in found} == {(n, 1), (1, n)} and len(rounds) <= 40
    rounds.clear()
    level = {r["name"]: r["level"] for r in chains.longest(path.selectExpr("explode(array(u, v)) name").distinct(), path.toDF("a", "b")).collect()}
    assert level == {f"p{k:05}": k for k in range(n)} and len(rounds) <= 40


def test_empty_graphs(spark):
    node, arc = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([], "u string, v string")
    assert [tuple(r) for r in G.strong_components(node, arc, 0).collect()] == [("x", "x")]
    assert [tuple(r) for r in G.layers(node, arc, 0).collect()] == [("x", "x", 0, 0)]
    assert G.strong_components(node.limit(0), arc, 0).collect() == []

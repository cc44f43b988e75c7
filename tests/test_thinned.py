"""Nodes with one way in or out are passed by before components are sought by rounds."""

from __future__ import annotations

import random

from corpusloom.operators import chains, diagnostics
from corpusloom.operators import graph as G
from tests.test_search import corpus, record


def test_thinned_and_put_back(spark):
    rng = random.Random(5)
    pairs = sorted({(f"g{g}-{rng.randrange(n)}", f"g{g}-{rng.randrange(n)}") for g in range(60) for n in [rng.choice([3, 6, 12, 30])] for _ in range(n * 4 // 3)})
    pairs = [(u, v) for u, v in pairs if u != v]
    nodes = sorted({n for p in pairs for n in p})
    arc, taken = chains.thinned(spark.createDataFrame(pairs, "u string, v string").repartition(3), 0, 0.02)
    left = [tuple(r) for r in arc.collect()]
    assert len(taken) > 2 and len(left) < len(pairs) / 2
    inner = spark.createDataFrame(sorted(G.components_of([n for p in left for n in p], left).items()), "name string, root string")
    found = [tuple(r) for r in chains.thickened(inner, taken).collect()]
    root, label = G.components_of(nodes, pairs), dict(found)
    assert len(label) == len(found)
    same = {}
    for n in nodes:
        same.setdefault(label.get(n, n), set()).add(root[n])
    assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(root.values()))


def test_graph_of_documents_takes_no_colours(spark, monkeypatch):
    n, names = 900, []
    pairs = [(f"doc-{i}", f"doc-{i // 3}") for i in range(3, n, 3)] + [(f"doc-{i}", f"doc-{(i * 7 + 1) % n}") for i in range(n)]
    for at in (G, chains):
        monkeypatch.setattr(at, "written", lambda df, name, keep=at.written: names.append(name) or keep(df, name))
    nodes = sorted({x for p in pairs for x in p})
    arc = spark.createDataFrame(sorted(set(pairs)), "u string, v string")
    found = {r["name"]: r["root"] for r in G.strong_components(spark.createDataFrame([(x,) for x in nodes], "name string"), arc, 600).collect()}
    assert found == G.components_of(nodes, pairs)
    assert "colour" not in names and len(names) < 40


def test_loops_of_graphs_broadcast_nothing(spark):
    ends = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("b", "d")], "u string, v string")
    level = chains.longest(ends.selectExpr("u name").distinct(), ends.where("u < v").selectExpr("u a", "v b"))
    found = G.strong_components(ends.selectExpr("explode(array(u, v)) name").distinct(), ends, 0)
    for frame in (level, found):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_counts_of_an_audit_order_nothing(spark, monkeypatch):
    ring = corpus(spark, record(0, "a", "one", requires=["b"]), record(1, "b", "two", requires=["a", "lost"]), record(2, "c", "three")).materialised()
    e = G.edges(ring)
    whole = diagnostics.audit(ring, e, [], 10)
    assert [(r["place"], r["kind"], r["skill_name"]) for r in whole["issues"].orderBy("place").collect()] == [(1, "validation", "b"), (2, "cycle", "a"), (3, "orphan", "c")]
    monkeypatch.setattr(G, "numbered", None)
    assert diagnostics.totals(diagnostics.audited(ring, e, [])).collect() == whole["counts"].collect()


def test_dense_graphs_are_walked_as_they_are(spark, monkeypatch):
    rng, names = random.Random(7), []
    pairs = sorted({(f"d{rng.randrange(40)}", f"d{rng.randrange(40)}") for _ in range(400)})
    nodes = sorted({n for p in pairs for n in p})
    for at in (G, chains):
        monkeypatch.setattr(at, "written", lambda df, name, keep=at.written: names.append(name) or keep(df, name))
    arc = spark.createDataFrame(pairs, "u string, v string")
    found = {r["name"]: r["root"] for r in G.strong_components(spark.createDataFrame([(n,) for n in nodes], "name string"), arc, 0, inside=True).collect()}
    assert found == G.components_of(nodes, pairs)
    assert "contracted" not in names and "thinned" not in names

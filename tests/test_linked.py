"""Graph queries take names and one relation, and their one task takes arcs alone."""

from __future__ import annotations

import random
import shutil

import pytest

from corpusloom.operators import chains, tables
from corpusloom.operators import corpus as C
from corpusloom.operators import graph as G
from corpusloom.plans import queries
from tests.test_search import record


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def names(monkeypatch):
    """What is written, by name."""
    found = []
    for at in (G, chains, C):
        monkeypatch.setattr(at, "written", lambda df, name, keep=at.written: found.append(name) or keep(df, name))
    return found


def test_nodes_without_arcs_stay_out_of_the_one_task(spark, names):
    nodes = [f"n{i:02}" for i in range(50)]
    pairs = [("n01", "n02"), ("n02", "n01"), ("n02", "n03"), ("n04", "n04"), ("n03", "n05")]
    node, arc = spark.createDataFrame([(n,) for n in nodes], "name string"), spark.createDataFrame(pairs, "u string, v string")
    root = G.components_of(nodes, pairs)
    read, apply = G.levels_of(root, pairs)
    want = sorted((n, root[n], read[n], apply[n]) for n in nodes)
    assert rows(G.layers(node, arc, 10)) == want
    assert rows(G.strong_components(node, arc, 10)) == sorted(root.items())
    assert names == []
    assert rows(G.layers(node, arc, 3)) == want and "arcs" in names


def test_short_paths_are_trimmed_not_contracted(spark, names):
    pairs = [(f"d{i}", f"d{i // 3}") for i in range(3, 300, 3)]
    nodes = [f"d{i}" for i in range(300)]
    node, arc = spark.createDataFrame([(n,) for n in nodes], "name string"), spark.createDataFrame(pairs, "u string, v string")
    read, apply = G.levels_of({n: n for n in nodes}, pairs)
    assert rows(G.layers(node, arc, 20)) == sorted((n, n, read[n], apply[n]) for n in nodes)
    assert "trimmed" in names and "contracted" not in names and names.count("weighted") == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_names_and_edges_are_those_of_the_corpus(spark, seed):
    rng = random.Random(seed)
    some = lambda: [rng.choice([f"n{rng.randrange(12)}", f"a{rng.randrange(6)}", f"lost{rng.randrange(3)}"]) for _ in range(rng.randrange(3))]
    docs = [record(k, f"n{rng.randrange(12)}", f"body {k}", aliases=some(), requires=some(), recommends=some(), mtime=float(rng.randrange(3)), root=rng.choice(["/a", "/b", "/c"])) for k in range(40)]
    d = spark.createDataFrame(docs, C.DOCUMENT)
    settings = C.Settings(scope_priority=["one"], scope_roots={"one": ["/b"], "two": ["/a"]})
    whole = C.build(d, settings)
    for relation in ("requires", "recommends"):
        name, edges = G.linked(d, settings, relation)
        assert rows(name) == rows(whole.documents.select("canonical_name"))
        assert rows(edges) == rows(G.edges(whole).where(f"relation = '{relation}'")) != []


def test_graph_queries_build_no_corpus(spark, tmp_path, monkeypatch):
    for name in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    few = ("read_layers", "layers_by_rounds", "scc", "scc_by_rounds", "cycle_list")
    found = queries.queries()
    try:
        tables.clear(spark)
        with monkeypatch.context() as m:
            m.setattr(C.Corpus, "materialised", lambda self: pytest.fail("bodies are written"))
            alone = {n: rows(found[n](spark, str(tmp_path))) for n in few}
        queries._corpus(spark, str(tmp_path))
        assert {n: rows(found[n](spark, str(tmp_path))) for n in few} == alone and all(alone.values())
    finally:
        tables.clear(spark)


def test_scopes_cut_no_path_into_prefixes(spark):
    roots = {"first": ["/x", "", "/y//z"], "second": ["/x/a", "x", "/x"], "third": ["/x/a/b/"]}
    paths = spark.createDataFrame([(p,) for p in ("", "/", "x", "x/", "xy", "x/a", "/x//a", "/x/a/", "/x/a//", "/x/ab", "/x/a/b", "/x/a/b/c/", "/y/z", "/y//z/q", "é", None)], "path string")
    got = paths.withColumn("scope", C.scope_of(paths["path"], roots, "none"))
    assert "sequence(" not in got._jdf.queryExecution().executedPlan().toString()
    want = C.classify_scopes(paths, C.scope_table(spark, roots), fallback="none")
    both = [sorted((r["path"] or "null", r["scope"]) for r in f.collect()) for f in (got, want)]
    assert both[0] == both[1]

"""Relations and decisions (A06-A23, R01-R11, D01-D12) on literal examples and random graphs."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import decide as D
from corpusloom.operators import diagnostics, packets
from corpusloom.operators import graph as G
from corpusloom.operators import index as I
from corpusloom.operators import search as S
from tests.test_search import corpus, record


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.fixture(scope="module")
def ring(spark):
    return corpus(
        spark,
        record(0, "alpha", "focus one", requires=["beta"], recommends=["gamma"]),
        record(1, "beta", "focus two", requires=["gamma"]),
        record(2, "gamma", "three", recommends=["delta"]),
        record(3, "delta", "four", requires=["beta", "lost"]),
        record(4, "epsilon", "five", recommends=["beta"]),
        record(5, "alone", "six"),
    ).materialised()


@pytest.fixture(scope="module")
def index(ring):
    return I.build_index(ring.documents)


def brute_components(nodes, pairs):
    near = G.adjacency(pairs)
    reach = {n: set(G.reach_of(pairs, [n])) for n in nodes}
    assert near is not None
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


graphs = st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=20)


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_components_and_levels(pairs):
    nodes = list("abcdefgh")
    root = G.components_of(nodes, pairs)
    assert root == brute_components(nodes, pairs)
    read, apply = G.levels_of(root, pairs)
    for u, v in pairs:
        if root[u] != root[v]:
            assert read[u] > read[v] and apply[v] > apply[u]


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("e", "a")]])
def test_distributed_forms_equal_local_ones(spark, pairs):
    arc = spark.createDataFrame(pairs, "u string, v string")
    nodes = spark.createDataFrame(sorted({(n,) for p in pairs for n in p} | {("z",)}), "name string")
    for work in (lambda k: G.strong_components(nodes, arc, k), lambda k: G.layers(nodes, arc, k), lambda k: G.reach(arc, [pairs[0][0]], False, k), lambda k: G.reach(arc, [pairs[0][1]], True, k)):
        near, far = work(G.LOCAL_EDGES), work(0)
        assert sorted(map(tuple, near.collect())) == sorted(tuple(r[c] for c in near.columns) for r in far.collect())


def test_order_dependent_composition():
    links = {"s": [("d", "d", "required"), ("a", "a", "recommended")], "d": [("c", "c", "required")], "c": [("a", "a", "required")], "a": [("b", "b", "required")]}
    best, _ = G.compose_of(["s"], lambda n: links.get(n, []))
    assert best == {"s": ("seed", 0, None), "d": ("required", 1, "s"), "b": ("required", 2, "a"), "c": ("required", 2, "d"), "a": ("required", 3, "c")}


def test_edges_orphans_cycles_degrees(ring):
    e = G.edges(ring)
    assert rows(e.where("not resolved"), "from_name", "target", "relation") == [("delta", "lost", "requires")]
    assert rows(G.orphans(ring, e), "name") == [("alone",)]
    cycle = G.cycles(ring.documents.select(F.col("canonical_name").alias("name")), G.arcs(e))
    assert [r["members"] for r in cycle.collect()] == [["beta", "delta", "gamma"]]
    found = diagnostics.audit(ring, e, [], 10)
    assert [r["name"] for r in found["top_inbound"].collect()] == ["beta", "gamma", "delta"]
    assert [r["name"] for r in found["top_outbound"].collect()][:2] == ["delta", "alpha"]
    one = found["counts"].first()
    assert (one["errors"], one["cycles"], one["orphans"], one["unresolved_relations"], one["ok"]) == (1, 1, 1, 1, False)


def test_compose_required(ring):
    entries, missing = G.compose(ring, G.edges(ring), ["delta"], False)
    assert rows(entries, "name", "reason", "depth", "via") == [("beta", "required", 1, "delta"), ("delta", "seed", 0, None), ("gamma", "required", 2, "beta")]
    assert rows(missing, "name", "relation", "via", "depth") == [("lost", "required", "delta", 1)]


def test_graph_modes(ring):
    e = G.edges(ring)
    assert rows(G.graph(ring, e, ["gamma"])["nodes"], "name") == [("beta",), ("delta",), ("gamma",)]
    assert rows(G.graph(ring, e, ["alpha"], "inbound")["nodes"], "name") == [("alpha",)]
    assert rows(G.graph(ring, e, [], "cycles")["nodes"], "name") == [("beta",), ("delta",), ("gamma",)]
    assert rows(G.graph(ring, e, [], "orphans")["nodes"], "name") == [("alone",)]


def test_decide_weights(ring, index):
    pool = D.candidates(ring, index, "focus", ["delta"], 10)
    decision = {r["name"]: r for r in D.decide(ring, pool, 10).collect()}
    hits = {r["canonical_name"]: r for r in S.ranked(ring, index, "focus", 10).collect()}
    beta = hits["beta"]["score"] + 0.25 + 2 * 4
    assert decision["beta"]["rank"] == 1 and abs(decision["beta"]["score"] - round(beta, 3)) < 1e-9 and decision["beta"]["peer_required_by"] == ["alpha", "delta"]
    assert abs(decision["delta"]["score"] - (0.5 - 2 - 4)) < 1e-9 and decision["delta"]["unresolved_requires"] == ["lost"]
    assert "required by peers: alpha, delta" in decision["beta"]["reasons"]


def bundle(ring, index, chars=4000):
    decision = D.decide(ring, D.candidates(ring, index, "focus", ["delta"], 50), 50)
    winner, steps, _ = D.plan(decision, True, 10)
    entries = G.project(ring, G.edges(ring), ["delta", "alpha", "beta"], False)["entries"]
    packed = packets.pack(ring, entries, chars, 1000).cache()
    phases = D.route(steps, entries).cache()
    omitted = [r["read_path"] for r in packed.where("omitted_by_budget").orderBy("name").collect()]
    return steps, packets.Bundle(phases, packets.brief(phases, packed).cache(), winner, omitted)


@pytest.fixture(scope="module")
def planned(ring, index):
    return bundle(ring, index)


def test_plan_route_turns(planned):
    steps, b = planned
    plan = steps.orderBy("order").collect()
    assert (plan[0]["name"], plan[0]["reason"]) == ("beta", "winner") and {p["name"] for p in plan[1:3]} == {"alpha", "delta"} and all(p["reason"] == "unblocks-required-peer" and p["via"] == "beta" for p in plan[1:3])
    kinds = [r["kind"] for r in b.phases.orderBy("order").collect()]
    assert kinds[0] == "start" and set(kinds[1:]) == {"read-layer"}
    turn = packets.turns(b).orderBy("order").first()
    assert turn["objective"] == "Start with winner beta" and turn["checklist"][-1] == "No omitted skill body in this turn." and turn["exit_criteria"][-1] == "Turn 1 is ready without extra budget recovery"
    assert b.ready and packets.blocked_turns(b).count() == 0


def test_packet_texts(planned):
    _, b = planned
    t = packets.texts(packets.current(b)).collect()
    assert len(t) == 1
    t = t[0]
    assert t["instruction_text"].startswith("Focus on turn 1 (start).\nRead skills: beta.\nStart with winner beta\nCommands:\nread(\"/r/beta/SKILL.md\")\nChecklist:\n1. ")
    assert t["summary_text"] == "beta turn 1: Start with winner beta. commands=1, checklist=3"
    assert t["markdown"].startswith("# beta turn 1\n\n## Summary\nFocus") and t["markdown"].endswith("## Recovery\n-")
    assert [f["path"] for f in t["files"]] == ["packets/beta-turn-1.md", "packets/beta-turn-1.checklist.md", "packets/beta-turn-1.commands.txt"]
    assert t["apply_text"].split("\n")[0] == "1. write packets/beta-turn-1.md (markdown)"
    assert t["execution_text"].endswith("3. Expect 3 file write operations.") and t["verification_text"].startswith("Run:\npython packets/beta-turn-1.write.py\n\nVerify:\n1. Reviewed skills: beta")
    compile(t["script_content"], "script", "exec")
    import json

    literal = t["script_content"].split("json.loads(")[1].split("[0])")[0]
    assert [w["path"] for w in json.loads(json.loads(literal + "")[0])] == [f["path"] for f in t["files"]]


def test_recovery(ring, index):
    _, b = bundle(ring, index, chars=10)
    blocked = packets.blocked_turns(b).orderBy("order").collect()
    assert not b.ready and blocked and blocked[0]["unblock_criteria"][0].startswith("Read omitted skill bodies: skill://")
    turn = packets.current(b).first()
    assert turn["order"] == blocked[0]["order"] and turn["blocked_by_budget"] and not turn["ready"] and turn["recovery_guidance"][1] == packets.APPLY_HINT


def test_compare_and_recommend(ring, index):
    entries, pairs = D.compare(D.candidates(ring, index, "focus", ["delta"], 8), 8)
    assert entries.count() == 3 and pairs.count() == 3
    pair = pairs.where("left_name = 'delta' and right_name = 'beta'").first()
    assert pair["left_to_right"] == "requires" and pair["right_to_left"] is None and pair["same_category"]
    got = {r["name"]: r for r in D.recommend(ring, index, G.edges(ring), ["alpha"], None, True, 10).collect()}
    assert got["beta"]["score"] == 4.5 and got["gamma"]["score"] == 2.5 and got["alone"]["score"] == 0.5 and "alpha" not in got
    assert {r["name"]: r["score"] for r in D.recommend(ring, index, G.edges(ring), ["alpha"], None, False, 10).collect()}["gamma"] == 0.5


def test_validate(spark):
    c = corpus(spark, record(0, "x", requires=["gone"], recommends=["lost"], path="/a"), record(1, "x", path="/b"), record(2, "y", aliases=["x"]))
    issues = diagnostics.validate(c)
    assert rows(issues, "severity", "kind") == [("error", "broken-required-relation"), ("error", "duplicate-canonical-name"), ("warning", "broken-recommended-relation"), ("warning", "duplicate-alias")]
    assert tuple(diagnostics.counts(issues).select("errors", "warnings", "ok").first()) == (2, 2, False)


def test_degrees_take_no_walk(ring, monkeypatch):
    e = G.edges(ring)
    whole = diagnostics.audit(ring, e, [], 10)
    monkeypatch.setattr(G, "strong_components", lambda *a: pytest.fail("components for degrees"))
    found = diagnostics.most_linked(ring, e, 10)
    assert found.keys() == {"top_inbound", "top_outbound"}
    assert all(found[k].collect() == whole[k].collect() != [] for k in found)

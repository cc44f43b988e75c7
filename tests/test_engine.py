"""All actions through the engine (A01-A36), hooks (X20-X23) and the entry points."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import hooks
from corpusloom.plans.engine import Engine
from corpusloom.plans.request import ACTIONS
from tests.test_search import corpus, record


@pytest.fixture(scope="module")
def engine(spark):
    c = corpus(
        spark,
        record(0, "alpha", "security review of metrics", aliases=["first"], requires=["beta"], root="/a"),
        record(1, "beta", "metrics templates", root="/a"),
        record(2, "gamma", "metrics runtime", recommends=["alpha"], root="/b"),
        scope_roots={"a": ["/a"], "b": ["/b"]},
        scope_priority=["b", "a"],
    )
    return Engine(c.materialised())


@pytest.mark.parametrize("action", ACTIONS)
def test_actions(engine, action):
    names = [] if action in ("discover", "search", "select", "gap") else ["alpha", "first"]
    result = engine.run(action, query=None if action == "resolve" else "metrics", names=names, task_size="large", limit=3)
    assert result.error is None and result.frames
    for frame in result.frames.values():
        frame.collect()
    text = result.text()
    assert text.startswith(f"{action}: ") and (action in ("validate", "audit", "metrics", "gap", "graph", "commands-packet", "recovery-packet") or "alpha" in text or "beta" in text)


def test_failures_are_results(engine, monkeypatch):
    monkeypatch.setattr(engine, "_search", lambda *_: 1 / 0)
    failed = engine.run("search", query="metrics")
    assert failed.error == "search failed: division by zero" and failed.text() == f"error: {failed.error}"
    assert engine.run("search", odd=1).error.startswith("search failed")


def test_orders_and_evidence(engine):
    """T03-T06, A01, X15."""
    composed = engine.run("compose", names=["gamma"], task_size="large").frames["entries"].orderBy("place").collect()
    assert [(r["name"], r["depth"]) for r in composed] == [("gamma", 0), ("alpha", 1), ("beta", 2)]
    graph = engine.run("graph", names=["gamma"], task_size="large").frames
    assert [r["name"] for r in graph["nodes"].collect()] == ["alpha", "beta", "gamma"]
    assert [(r["from_name"], r["to_name"]) for r in graph["edges"].collect()] == [("alpha", "beta"), ("gamma", "alpha")]
    assert [(r["layer"], r["name"]) for r in graph["read_layers"].collect()] == [(0, "beta"), (1, "alpha"), (2, "gamma")]
    facts = engine.run("search", query="metrics", names=["alpha", "nobody"], task_size="large").facts
    assert facts["why_top"].startswith(f"{facts['telemetry']['returned'][0]} matched metrics with score") and facts["missing_requested"] == ["nobody"] and facts["telemetry"]["complaint"] == "drift"
    none = engine.run("search", query="zzzz", task_size="large")
    assert none.facts["fallback_mode"] == "safe-zero" and none.facts["why_none"] and none.facts["telemetry"]["complaint"] == "miss"
    index = engine.run("index", names=["beta", "nobody"]).facts
    assert (index["documents"], index["name_filter"], index["missing_from_requested"]) == (1, "targeted", ["nobody"])
    lost = engine.run("resolve", names=["x" * 200 + str(n) for n in range(60)])
    assert len(lost.text().encode()) <= 4096 and lost.facts["resolved"] == 0


def test_errors(engine):
    assert engine.run("search").error and engine.run("decide", query="metrics").error and engine.run("resolve").error and engine.run("what").error


def test_results(engine):
    hits = engine.run("search", query="metrics", task_size="large").frames["hits"].orderBy("rank").collect()
    assert {h["name"] for h in hits} == {"alpha", "beta", "gamma"} and hits[0]["read_path"].startswith("skill://")
    assert {h["name"] for h in engine.run("search", query="metrics", scopes=["b"]).frames["hits"].collect()} == {"gamma"}
    assert engine.run("search", query="metrics", scopes=["odd"]).frames["hits"].count() == 0
    assert engine.run("index", names=["beta"]).facts["documents"] == 1
    # by names alone a decision sees the named documents only, so what they require is unresolved
    decided = engine.run("decide", names=["alpha"]).frames["candidates"].first()
    assert decided["unresolved_requires"] == ["beta"]
    packed = engine.run("pack", names=["alpha"], task_size="large")
    assert {r["name"] for r in packed.frames["entries"].collect()} == {"alpha", "beta"} and packed.facts["ok"]


def test_catalogue_rewrites(spark):
    frame = spark.createDataFrame([("a<skills>x</skills>b<skills>y</skills>",), ("<skills>open",), ("</skills><skills>",), (None,)], "t string")
    got = [r["x"] for r in frame.select(hooks.rewrite_catalog(F.col("t"), "G").alias("x")).collect()]
    assert got == ["aGb<skills>y</skills>", None, None, None]
    assert hooks.rewrite_text("a<skills>x</skills>b", "G") == "aGb" and hooks.rewrite_text("none") is None
    blocks = spark.createDataFrame([(["one", "<skills>x</skills>", "two"],)], "b array<string>")
    assert blocks.select(hooks.rewrite_blocks(F.col("b"), "G").alias("x")).first()["x"] == "one\n\nG\n\ntwo"


def test_payload_rewrites(spark):
    block = "<skills>x</skills>"
    assert hooks.rewrite_payload({"instructions": block, "messages": [{"role": "system", "content": block}]}, "G") == {"instructions": "G", "messages": [{"role": "system", "content": block}]}
    body = {"messages": [{"role": "user", "content": block}, {"role": "developer", "content": [{"text": "no"}, {"text": block}, {"text": block}]}]}
    assert hooks.rewrite_payload(body, "G")["messages"][1]["content"] == [{"text": "no"}, {"text": "G"}, {"text": block}]
    assert hooks.rewrite_payload({"messages": [{"role": "user", "content": block}]}) is None and hooks.rewrite_payload("x") is None
    frame = spark.createDataFrame([('{"instructions": "<skills></skills>"}',), ("{}",), (None,)], "t string")
    got = [r["x"] for r in frame.select(hooks.rewrite_payload_json(F.col("t")).alias("x")).collect()]
    assert got[0].startswith('{"instructions": "<skills>') and got[1:] == [None, None]


def test_messages(spark):
    m = spark.createDataFrame([(1, 0, "user", "<skills></skills>"), (1, 1, "system", "plain"), (1, 2, "developer", "a<skills></skills>"), (1, 3, "system", "<skills></skills>"), (2, 0, "system", None)], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["text"], r["rewritten"]) for r in hooks.rewrite_messages(m, guidance="G").collect()}
    assert got == {(1, 0): ("<skills></skills>", False), (1, 1): ("plain", False), (1, 2): ("aG", True), (1, 3): ("<skills></skills>", False), (2, 0): (None, False)}


def test_unknown_reads(spark):
    text = "Unknown skill: x\nAvailable: many"
    cases = [("read", True, "skill://a%20b%07", text), ("read", True, "skill://100%", text), ("read", True, "skill://" + "é" * 400, text), ("read", True, "skill://", text), ("read", False, "skill://a", text), ("write", True, "skill://a", text), ("read", True, "file://a", text), ("read", True, "skill://a", "Unknown skill: x")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tool_name string, is_error boolean, path string, text string")
    got = [r["compacted"] for r in hooks.compact_unknown_reads(frame).orderBy("i").collect()]
    first = [None if g is None else g.split("\n")[0] for g in got]
    assert first == ["Unknown skill: a b", "Unknown skill: 100%", "Unknown skill: " + "é" * 256, "Unknown skill: (empty)", None, None, None, None]


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["rank", "name", "score", "coverage"] and frame.count() > 0
    known = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= known and len(known) > 50

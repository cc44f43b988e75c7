"""Markdown source, snapshots, settings, requests, streaming."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators.corpus import Settings
from corpusloom.plans.request import Request, RequestError, canonical_name, expand_root, roots_for_scopes
from corpusloom.plans.engine import Engine
from corpusloom.sources import markdown as M
from corpusloom.sources.settings import load_settings
from corpusloom.sources.snapshot import SnapshotError, Store
from corpusloom.streaming import incremental
from tests.test_search import corpus, record

GUIDE = """---\r
name: Skill-My Cartographers Guide.md\r
group: Runtime
tag: ['Ops', "reliability"]
keywords: Tracing, slo; latency
aliases:
  - Map Guide
  - my-cartographers-guide
requires: base-tools, "quoted"
depends_on: ignored
recommends: [related-reads, base-tools]
stray line

Name2: x
---
# The Guide

Body text.
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    for path, text in {"guide/SKILL.md": GUIDE, "plain/SKILL.md": "no front\n", "node_modules/x/SKILL.md": "skipped", "deep/a/b/SKILL.md": "---\nname:\n---\nx", "bad/SKILL.md": None, "other/NOTE.md": "n"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(b"\xff\xfe\xff" if text is None else text.encode())
    return str(top)


def test_scan_and_parse(spark, root):
    files = M.scan(spark, root)
    assert sorted(r["path"].removeprefix(root) for r in files.collect()) == ["/bad/SKILL.md", "/deep/a/b/SKILL.md", "/guide/SKILL.md", "/plain/SKILL.md"]
    good, bad = M.parse(files, root)
    got = {r["canonical_name"]: r for r in good.collect()}
    assert set(got) == {"my-cartographers-guide", "plain", "b"}
    g = got["my-cartographers-guide"]
    assert (g["category"], g["title"], g["keywords"], g["tags"]) == ("Runtime", "The Guide", ["tracing", "slo", "latency"], ["ops", "reliability"])
    assert g["aliases"] == ["map-guide"] and g["recommends"] == ["related-reads"] and g["requires"][0] == "base-tools"
    assert [r["path"].removeprefix(root) for r in bad.collect()] == ["/bad/SKILL.md"]


def test_targeted_scan(spark, root):
    assert M.scan(spark, root, names=["guide"]).count() == 1
    assert M.scan(spark, root, names=["guide", "unknown"]).count() == 4
    assert M.scan(spark, root, names=["../guide"]).count() == 4
    assert M.scan(spark, root + "/none") is None
    assert not any(map(M.safe_name, ("", ".", "..", "/x", "a/b", "a\\b"))) and M.safe_name("x")


def test_manifest(spark, root):
    files = M.scan(spark, root)
    digest = M.manifest(files)
    assert len(digest) == 64 and digest == M.manifest(files.repartition(3)) and digest != M.manifest(files.limit(3))


def test_load_and_snapshot(spark, root, tmp_path):
    settings = Settings(scope_roots={"all": [root]}, scope_priority=["all"])
    c, facts = M.load(spark, [root, root + "/none"], settings)
    assert facts["missing_roots"] == [root + "/none"] and {r["scope"] for r in c.documents.collect()} == {"all"}
    # roots outside the selected scopes aren't looked at
    assert M.load(spark, [root, "/elsewhere"], settings, scopes=["all"])[1]["missing_roots"] == []
    store = Store(spark, str(tmp_path / "snap"))
    assert store.load({}, settings) is None
    token = store.save(c, {"a": 1}, facts["signatures"][0], now_ms=1000)
    assert store.load({"a": 2}, settings, now_ms=1001) is None
    assert store.load({"a": 1}, settings, now_ms=1000 + settings.cache_ttl_ms) is None
    assert store.load({"a": 1}, settings, "other", now_ms=1001) is None
    held, index, same = store.load({"a": 1}, settings, facts["signatures"][0], now_ms=1001)
    assert same == token and held.documents.count() == 3 and index.n_docs == 3
    store.require(token)
    store.save(c, {"a": 1}, "s", now_ms=2000)
    with pytest.raises(SnapshotError):
        store.require(token)
    # a pointer that was only half written leaves the one before; none is ever overwritten
    last = store.facts()["token"]
    store._write("current-000000009", "{broken")
    assert store.facts()["token"] == last and store.load({"a": 1}, settings, now_ms=2001)[2] == last
    with pytest.raises(Exception):
        store._write("current-000000009", "{}")
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "file").write_text("x")
    with pytest.raises(SnapshotError):
        Store(spark, str(tmp_path / "else"))


def test_settings(tmp_path):
    first, second = tmp_path / "a.json", tmp_path / "b.json"
    first.write_text("{broken")
    second.write_text(json.dumps({"corpusloom": {"maxTopK": 7, "scopeRoots": {"x": "~/s", "y": ["$cwd/t"]}, "scopePriority": ["y", "z", "y"], "cacheTtlMs": "no"}}))
    s = load_settings([tmp_path / "none", first, second], home="/h", cwd="/w")
    assert (s.max_top_k, s.scope_roots, s.scope_priority, s.cache_ttl_ms) == (7, {"x": ["/h/s"], "y": ["/w/t"]}, ["y"], 60_000)
    assert load_settings([]) == Settings()


def test_requests():
    s = Settings(scope_roots={"a": ["/a"]}, preset_names=["P One"])
    r = Request("search", query=" q ", names=["B.md", "a", "skill-B", ""], limit=500, task_size="large").normalised(s)
    assert (r.query, r.names, r.limit, r.relation_mode, r.include_body) == ("q", ["a", "b"], 50, "full", True)
    assert Request("resolve", names=["b", "a"]).normalised(s).names == ["b", "a"]
    assert Request("search", query="q").normalised(s).limit == 5 and Request("search", query="q", task_size="small", limit=9).normalised(s).limit == 2
    assert Request("plan", query="q", names=["x"]).normalised(s).relation_mode == "required"
    for bad in (Request("nothing"), Request("decide", query="q"), Request("search", query="x" * 2000)):
        with pytest.raises(RequestError):
            bad.normalised(s)
    assert Request("index").normalised(s).corpus_names(s) == ["p-one"] and Request("decide", query="q", names=["x"], task_size="large").normalised(s).corpus_names(s) == []
    assert Request("decide", names=["x"]).normalised(s).corpus_names(s) == ["x"] and Request("instruction-packet", query="q", names=["x"]).normalised(s).corpus_names(s) == ["x"]
    assert Request("index", scopes=["a", "odd"]).known_scopes(s) == [] and Request("index", scopes=["a"]).known_scopes(s) == ["a"] and Request("index").known_scopes(s) is None
    assert canonical_name(" Skill_Two  Words.MD ") == "two-words" and expand_root("$home/x/", "/h", "/w") == "/h/x"
    assert roots_for_scopes(["/a/b", "/a", "/ab", "/c"], ["/a"]) == ["/a/b", "/a"]


def test_stream_of_documents(spark, tmp_path):
    c = corpus(spark, record(0, "x", "one two"), record(1, "y", "two three"))
    c.documents.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(c.documents.schema).parquet(str(tmp_path / "in"))
        incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    want = sorted(map(tuple, I.postings(c.documents).select("term", "skill_id", "n_tokens", "tf", "wtf").collect()))
    assert sorted(map(tuple, incremental.current(spark, str(tmp_path / "out")).collect())) == want
    later = corpus(spark, record(0, "x", "four", mtime=9.0), record(2, "z", "six", mtime=9.0))
    later.documents.write.mode("append").parquet(str(tmp_path / "in"))
    incremental.follow(spark.readStream.schema(c.documents.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    terms = {r["term"] for r in incremental.current(spark, str(tmp_path / "out")).where("skill_id = 'x'").collect()}
    assert "four" in terms and "one" not in terms
    # one that is sent again without a token, and one with a null body, leave nothing
    gone = later.documents.withColumn("body_text", F.when(F.col("canonical_name") == "x", F.lit("the")).otherwise(F.lit(None)))
    none = F.array().cast("array<string>")
    gone = gone.withColumns({c: F.lit("") for c in ("canonical_name", "title", "category")} | {c: none for c in ("aliases", "keywords", "tags")} | {"mtime_ms": F.lit(10.0)})
    gone.select(*c.documents.columns).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.follow(spark.readStream.schema(c.documents.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    left = incremental.current(spark, str(tmp_path / "out"))
    assert {r["skill_id"] for r in left.collect()} == {"y"}
    incremental.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert sorted(map(tuple, incremental.current(spark, str(tmp_path / "small")).collect())) == sorted(map(tuple, left.collect()))


def test_frontmatter_lines():
    block = "Name: One\n_key : no\nkey : no\ntags:\n-a\n  - 'b'\n\n  indented\n- c : d\nother\n- lost\nempty:\n2nd: no\ntag:   \nname: Two"
    assert M.parse_front(block) == {"name": ["\0Two"], "tags": ["a", "b", "c : d"], "empty": [], "tag": []}


def test_engine_over_snapshots(spark, root, tmp_path):
    """Versions are reused while fresh and while sources are unchanged; refresh makes a new one."""
    settings = Settings(scope_roots={"all": [root]}, scope_priority=["all"])
    built = []

    def build():
        built.append(1)
        return M.load(spark, [root], settings)[0]

    store = Store(spark, str(tmp_path / "snap"))
    sign = lambda: M.manifest(M.scan(spark, root))
    engine = Engine.over(store, settings, build, sign)
    assert engine.run("index").facts["documents"] == 3 and len(built) == 1
    assert Engine.over(store, settings, build, sign).run("index").facts["documents"] == 3 and len(built) == 1
    first = engine._token
    assert engine.run("index", refresh=True).error is None and len(built) == 2 and engine._token != first
    extra = Path(root) / "later"
    extra.mkdir()
    (extra / "SKILL.md").write_text("# Later\nwords")
    assert engine.run("index").facts["documents"] == 4 and len(built) == 3
    assert engine.run("search", query="words", task_size="large").frames["hits"].count() >= 1

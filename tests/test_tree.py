"""The walk of a tree as a data source (S01-S05): order, pruning, what can't be read."""

from __future__ import annotations

import os
import random

import pytest

from corpusloom.operators.corpus import Settings
from corpusloom.sources import markdown as M
from corpusloom.sources import walk as W

NAMES, SKIPPED = ("SKILL.md", "NOTE.md"), (".git", "node_modules")


def stack_walk(root):
    """The walk by the plainest means."""
    out, stack = [], [root]
    while stack:
        here = stack.pop()
        entries = sorted(os.listdir(here), key=os.fsencode)
        for name in entries:
            path = os.path.join(here, name)
            if os.path.islink(path):
                continue
            if os.path.isdir(path):
                if name not in SKIPPED:
                    stack.append(path)
            elif name in NAMES:
                out.append(path)
    return out


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng, top = random.Random(4), tmp_path_factory.mktemp("tree")
    folders = [top]
    for i in range(120):
        parent = rng.choice(folders[-30:])
        name = rng.choice(["a", "ab", "b", "é", "node_modules", ".git", f"d{i}", f"D{i}"])
        (parent / name).mkdir(exist_ok=True)
        folders.append(parent / name)
    for folder in folders:
        for name in (*NAMES, "other.md"):
            if rng.random() < 0.5:
                (folder / name).write_text(f"{folder} {name}")
    (top / "linked").symlink_to(folders[1])
    return str(top)


@pytest.mark.parametrize("wide", [1, 3, 17, 1000])
def test_every_plan_walks_alike(tree, wide):
    names, skipped = frozenset(NAMES), frozenset(SKIPPED)
    runs = W.planned(tree, names, skipped, wide)
    assert [r.nth for r in runs] == list(range(len(runs)))
    assert [p for r in runs for p in W.found(r, names, skipped)] == stack_walk(tree)


def test_source(spark, tree):
    files = W.walk(spark, tree, NAMES, SKIPPED, wide=9)
    rows = files.orderBy("place").collect()
    assert [r["path"] for r in rows] == stack_walk(tree)
    assert all(r["content"].decode() == " ".join(os.path.split(r["path"])) and r["size"] == len(r["content"]) for r in rows)
    thin = W.walk(spark, tree, NAMES, SKIPPED, contents=False)
    assert thin.columns == ["path", "size", "mtime_ms", "place"] and thin.count() == len(rows)
    assert files.rdd.getNumPartitions() > 3
    # skipped names are not even listed
    seen = []
    real = os.scandir
    os.scandir = lambda p: (seen.append(p), real(p))[1]
    try:
        runs = W.planned(tree, frozenset(NAMES), frozenset(SKIPPED), 10**6)
    finally:
        os.scandir = real
    assert runs and not any(part in SKIPPED for p in seen for part in os.fspath(p).split(os.sep))


def test_vanished_and_unreadable(spark, tmp_path):
    for name in ("gone", "kept", "shut"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(name)
    reader = W.WalkReader({"root": str(tmp_path), "names": '["SKILL.md"]', "skipped": "[]"})
    plan = reader.partitions()
    (tmp_path / "gone" / "SKILL.md").unlink()
    (tmp_path / "gone").rmdir()
    rows = [r for run in plan for b in reader.read(run) for r in b.to_pylist()]
    assert [(os.path.basename(os.path.dirname(r["path"])), r["content"]) for r in rows] == [("shut", b"shut"), ("kept", b"kept")]
    assert W.walk(spark, str(tmp_path / "none"), NAMES, SKIPPED).count() == 0
    (tmp_path / "empty").mkdir()
    assert W.walk(spark, str(tmp_path / "empty"), NAMES, SKIPPED).count() == 0


def test_corpus_in_order_of_the_walk(spark, tree, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "SKILL.md").write_bytes(b"\xff")
    c, facts = M.load(spark, [str(tmp_path), tree, tree + "/none"], Settings(), file_names=NAMES)
    assert facts["missing_roots"] == [tree + "/none"] and len(facts["signatures"]) == 2
    records = [(r["path"], r["canonical_name"]) for r in M.parse(M.sources(spark, tree, NAMES)[0], tree)[0].orderBy("ordinal").collect()]
    assert [p for p, _ in records] == stack_walk(tree)
    # a name stands where its first file does
    assert [r["canonical_name"] for r in c.documents.orderBy("ordinal").collect()] == list(dict.fromkeys(n for _, n in records))
    assert [r["path"] for r in c.malformed.collect()] == [str(tmp_path / "bad" / "SKILL.md")]
    # the digest of the sources needs no contents
    assert facts["signatures"][1] == M.manifest(W.walk(spark, tree, NAMES, M.SKIPPED))


def test_many_siblings_go_in_runs(tmp_path):
    for i in range(500):
        (tmp_path / f"d{i:03d}").mkdir()
        (tmp_path / f"d{i:03d}" / "SKILL.md").write_text("x")
    runs = W.planned(str(tmp_path), frozenset(NAMES), frozenset(SKIPPED), 8)
    assert 8 <= len(runs) <= 9 and sum(len(r.tops) for r in runs) == 500

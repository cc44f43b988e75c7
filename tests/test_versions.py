"""Snapshots that follow a corpus by what has changed (S15-S17), against whole builds."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators.corpus import Settings
from corpusloom.plans.engine import Engine
from corpusloom.sources import snapshot
from corpusloom.sources.snapshot import Store
from tests.test_search import corpus, record

WORDS = "amber basalt cedar dune ember fjord garnet heath islet juniper".split()


def bodies(rng, n):
    return {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for i in range(n)}


def made(spark, held):
    return corpus(spark, *[record(i, f"doc-{i}", body, requires=[f"doc-{i // 2}"] if i else []) for i, body in sorted(held.items())])


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def same(held, c):
    """The stored corpus and index are those of a whole build."""
    whole = I.build_index(c.documents, persist=False)
    got_corpus, got = held
    assert rows(got_corpus.documents) == rows(c.documents) and rows(got_corpus.aliases) == rows(c.aliases)
    assert rows(got.postings) == rows(whole.postings) and rows(got.vocab) == rows(whole.vocab)
    assert (got.n_docs, got.avg_len) == (whole.n_docs, whole.avg_len)
    hits = lambda x: rows(S.ranked(c, x, "amber dune garnet", 10).select("rank", "canonical_name", "score", "coverage"))
    assert hits(got) == hits(whole)


def test_random_changes(spark, tmp_path):
    rng, store, settings = random.Random(5), Store(spark, str(tmp_path / "s")), Settings()
    held = bodies(rng, 40)
    tokens = [store.save(made(spark, held), {}, "0")]
    for step in range(3):
        new, gone, changed = 100 + step, rng.choice(sorted(held)), rng.choice(sorted(held))
        held[changed] = f"amber changed {step}"
        del held[gone]
        held[new] = "" if step == 1 else "dune garnet fresh"
        tokens.append(store.save(made(spark, held), {}, str(step)))
        assert store.facts()["parts"] == tokens
        # only what differs is written
        written = {r[0] for r in spark.read.parquet(f"{store.folder}/{tokens[-1]}/postings").select("skill_id").distinct().collect()}
        assert written <= {f"doc-{changed}", f"doc-{new}"}
        same(store.frames(settings), made(spark, held))
    # a document that comes back
    held[gone] = "amber again"
    store.save(made(spark, held), {}, "back")
    same(store.frames(settings), made(spark, held))


def test_nothing_changed_and_too_much(spark, tmp_path):
    store, held = Store(spark, str(tmp_path / "s")), bodies(random.Random(6), 12)
    first = store.save(made(spark, held), {}, "a")
    second = store.save(made(spark, held), {}, "b")
    assert store.facts()["token"] == second and store.facts()["parts"] == [first]
    same(store.frames(Settings()), made(spark, held))
    other = {i: "fjord" for i in range(12)}
    third = store.save(made(spark, other), {}, "c")
    assert store.facts()["parts"] == [third]
    same(store.frames(Settings()), made(spark, other))
    fourth = store.save(made(spark, {}), {}, "d")
    assert store.facts()["parts"] == [fourth] and store.facts()["avg_len"] == 0
    assert store.frames(Settings())[1].postings.count() == 0
    assert store.save(made(spark, held), {}, "e") == store.facts()["parts"][-1]
    same(store.frames(Settings()), made(spark, held))


def test_parts_are_bounded_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "PARTS_MOST", 2)
    store, held, tokens = Store(spark, str(tmp_path / "s")), bodies(random.Random(7), 10), []
    for step in range(3):
        held[step] = f"ember step {step}"
        tokens.append(store.save(made(spark, held), {}, str(step)))
    assert store.facts()["parts"] == tokens[2:]
    store._write("current-000000009", "{broken")
    assert store.prune(kept=2) == []
    assert sorted(store.prune(kept=1)) == sorted(tokens[:2])
    assert store._exists(tokens[2]) and not store._exists(tokens[0])
    same(store.frames(Settings()), made(spark, held))
    # numbers go on after a prune
    store.save(made(spark, held), {}, "next")
    assert store._pointers()[0] == "current-000000010"


def test_pinned_engine_refuses_what_is_stale(spark, tmp_path):
    store, held = Store(spark, str(tmp_path / "s")), bodies(random.Random(8), 12)
    with pytest.raises(snapshot.SnapshotError):
        Engine.pinned(store, Settings())
    store.save(made(spark, held), {}, "a")
    engine = Engine.pinned(store, Settings())
    found = engine.run("search", query="amber")
    assert found.error is None and found.frames["hits"].count() > 0
    held[0] = "changed"
    store.save(made(spark, held), {}, "b")
    late = engine.run("search", query="amber", refresh=True)
    assert "no longer current" in late.error and late.frames == {}
    assert found.frames["hits"].count() > 0
    assert Engine.pinned(store, Settings()).run("search", query="changed").frames["hits"].count() == 1

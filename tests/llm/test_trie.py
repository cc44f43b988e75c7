from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a long, `a.b` string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [said for _, said in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].add(c)
        ends[tuple(built[c])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, convs in members.items()
    )


def in_order(found):
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1], r[2] is not None, r))


def random_rows(rng, convs, longest):
    rows, said = [], [("user", "Hello"), ("assistant", "é"), (None, None), ("user", ""), ("user", "long " * 30)]
    for c in convs:
        for k in range(rng.randint(1, longest)):
            rows.append((c, k if k else None, *(said[0] if rng.random() < 0.7 else rng.choice(said))))
    return rows


@pytest.mark.parametrize(("seed", "n", "longest", "small"), [(1, 120, 12, False), (2, 60, 30, True), (3, 3, 1, False)])
def test_against_brute_force(spark, seed, n, longest, small, monkeypatch):
    if small:  # several windows a conversation, many pieces a node, streams of pieces
        monkeypatch.setattr(trie.prefixes, "__defaults__", (4,))
        monkeypatch.setattr(trie.ends, "__defaults__", (3, 1))
    rng = random.Random(seed)
    rows = random_rows(rng, rng.sample(range(4 * n), n), longest) + [(None, 1, "user", "of nobody")]
    # copies, of which many end at one node, and a conversation that is much longer than the others
    rows += [(10_000 + c, k, "user", "Hello") for c in range(40) for k in range(9)] + [(20_001, k, "user", f"turn {k}") for k in range(70)]
    # whose own turns and lender are both missing, so that nothing is left
    rows += [(30_004 + 5 * k, 0, "user", "x") for k in range(8)]
    rng.shuffle(rows)
    found = trie.report(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3))
    assert in_order(found) == sorted(brute(rows), key=lambda r: (r[0], r[1], r[2] is not None, r))


def test_ties_and_repeated_rows(spark):
    rows = [(5, 1, "user", t) for t in ("b", "a", "a", "c")] + [(5, None, "user", "first"), (5, None, "user", "first")]
    for order in (rows, rows[::-1]):
        found = in_order(trie.report(spark.createDataFrame([(*r, 0, 0, "") for r in order], SCHEMA)))
        assert [r[1] for r in found] == list(range(7)) and [r[3] for r in found] == [1] * 7
        assert order is rows or found == before
        before = found


def test_no_conversation(spark):
    assert trie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.report(spark.createDataFrame([(None, 1, "user", "x", 0, 0, "")], SCHEMA)).collect() == []


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    n, rounds, keep = 300, [], trie.written
    path = [(k + 1, 0, k if k else None, 0 if k else None, k, 1) for k in range(n)]
    tree = spark.createDataFrame(path, "a long, b long, pa long, pb long, depth long, one long")
    monkeypatch.setattr(trie, "written", lambda df, name: rounds.append(name) or keep(df, name))
    found = {r["a"]: r["one"] for r in trie.subtree_sums(tree, ("one",)).collect()}
    assert found == {k + 1: n - k for k in range(n)} and len(rounds) == 9


def test_digests_run_over_chunks(spark):
    rows = [(c, k, k % 3, 7, 1) for c in (1, 2) for k in range(20)]
    said = spark.createDataFrame(rows, "c long, pos long, x long, y long, bytes long")
    whole = {tuple(r) for r in trie.prefixes(said).collect()}
    assert whole == {tuple(r) for r in trie.prefixes(said, 3).collect()} and len(whole) == 40
    assert len({r[3:5] for r in whole}) == 20
    assert said.where(F.col("pos") < 0).count() == trie.prefixes(said.where("pos < 0")).count() == 0

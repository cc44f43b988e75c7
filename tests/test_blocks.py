"""The best of a search by blocks of falling score (T01, X12), against all scores."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import blocks
from corpusloom.operators import index as I
from corpusloom.operators import search as S
from tests.test_search import corpus, record

WORDS = "amber basalt cedar dune ember fjord".split()


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(11)
    made = [record(i, f"doc-{i:03d}", " ".join(rng.choices(WORDS, weights=[9, 5, 3, 2, 1, 1], k=rng.choice((0, 3, 8, 40, 200))))) for i in range(300)]
    # repeated texts, so that scores are tied
    made += [record(300 + i, f"same-{i}", "dune dune ember") for i in range(30)]
    c = corpus(spark, *made)
    return c, I.build_index(c.documents)


def variants(*rows):
    return [S.Variant(place, term, term, "base", weight) for place, term, weight in rows]


def best(df, k):
    """Documents that reach the k-th score, with all that is told of them."""
    rows = sorted((r["score"], r["skill_id"], r["coverage"], tuple(r["matched_terms"])) for r in df.collect())[::-1]
    return [r for r in rows if len(rows) < k or r[0] >= rows[k - 1][0]]


@pytest.mark.parametrize("asked", [
    [(0, "amber", 1.0)],
    [(0, "amber", 1.0), (1, "dune", 1.0)],
    [(0, "amber", 0.7), (0, "basalt", 0.7), (1, "ember", 1.0), (2, "fjord", 0.25)],
    # a term of two tokens, and one that isn't there
    [(0, "dune", 1.0), (1, "dune", 0.45), (2, "nowhere", 1.0)],
])
def test_same_as_all_scores(crowd, asked):
    _, index = crowd
    found = variants(*asked)
    whole = S.score(index, found)
    for k in (1, 10, 1000):
        got = S.score_leading(index, found, k, direct=0)
        assert best(got, k) == best(whole, k)


def test_ranked_and_few_postings(crowd, monkeypatch):
    c, index = crowd
    got = S.ranked(c, index, "amber ember", 10, direct=0).drop("scope_rank")
    want = S.ranked(c, index, "amber ember", 10).drop("scope_rank")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # what is scored in full is a part of the postings, named or joined
    weighted = [(0, "ember", 1.0)]
    few = blocks.leading(index, weighted, 10, S.K1, S.B)
    assert 10 <= few.count() < index.postings.where("term = 'ember'").count()
    monkeypatch.setattr(blocks, "NAMED", 3)
    assert sorted(few.collect()) == sorted(blocks.leading(index, weighted, 10, S.K1, S.B).select(few.columns).collect())


def test_nothing_to_find(spark, crowd):
    _, index = crowd
    assert S.score_leading(index, [], 5, direct=0).count() == 0
    assert S.score_leading(index, variants((0, "nowhere", 1.0)), 5, direct=0).count() == 0
    c = corpus(spark)
    empty = I.build_index(c.documents)
    assert S.ranked(c, empty, "amber", 5, direct=0).count() == 0


def test_unread_stays_below_the_floor():
    rng = random.Random(3)
    for _ in range(300):
        levels = [sorted((rng.random() * 5, rng.randint(1, 100)) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        floor = rng.random() * 8
        taken = blocks.unread(levels, floor)
        spent = [rows[n - 1][0] if n else 0.0 for rows, n in zip(levels, taken)]
        assert sum(spent) < floor + 1e-9
        # no further block fits
        for j, (rows, n) in enumerate(zip(levels, taken)):
            assert n == len(rows) or sum(spent) - spent[j] + rows[n][0] >= floor - 1e-9

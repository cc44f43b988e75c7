"""Operator 2: statistics and fit against brute force, and defined results."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality
from corpusloom.llm.common import text_bytes

TEXTS = ["", None, "one", "  \n \n", "A b! c? d.", "x x x x", "a b c a b c a b c", "line one\nline one\n\nline two", "héé ÜÜ ✓ | # 12 3", "The quick, brown; fox: 99 %&* " * 40, "w" * 500]


def plain_vector(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    dark, n = sum(map(len, words)), len(words)
    share = lambda a, b: a / max(b, 1)
    chars = {"symbols": b"#*$%&<>@^~=_{}[]\\+/", "bars": b"|", "shouts": b"!?", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b",.:;"}
    out = [math.log(share(sum(c in chars[k] for c in raw), dark) + 0.01) for k in quality.CLASSES]
    log_words = math.log(n + 1) / 4
    out += [math.log(share(dark, n) + 1), log_words, math.log(share(sum(a == b for a, b in zip(words, words[1:])), n) + 0.01)]
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    out += [math.log(share(len(grams) - len(set(grams)), n) + 0.01), math.log1p(-0.99 * share(n - len(set(words)), n)) / max(log_words, 0.5)]
    lines = [x for x in raw.split(b"\n") if x]
    return [*out, math.log(share(len(lines) - len(set(lines)), len(lines)) + 0.01), math.log(share(n, len(lines)) + 1) / 4]


def test_vectors_match_brute_force():
    got = quality.vectors(*text_bytes(pa.array(TEXTS)))
    assert np.allclose(got, [plain_vector(t) for t in TEXTS], atol=1e-12)
    # a text's vector does not depend on what stands beside it
    assert all(np.allclose(quality.vectors(*text_bytes(pa.array([t], pa.string()))), got[i : i + 1]) for i, t in enumerate(TEXTS))


def pairs_of(y, per_row):
    """The pairs of a fit: those of every good row, and those of every bad one."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(0)
    left = np.concatenate([np.repeat(good, per_row), draw.choice(good, len(bad) * per_row)])
    return left, np.concatenate([draw.choice(bad, len(good) * per_row), np.repeat(bad, per_row)])


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_maximises_the_likelihood_of_preferences(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(80, 4)) * [1, 5, 0.1, 2] + [0, 3, -1, 0]
    y = (x @ [1.0, -0.4, 3.0, 0.2] + rng.normal(size=80) > -4).astype(int)
    model = quality.fit(x, y, pairs_per_row=6, ridge=1e-2)
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3), -8, 8)
    left, right = pairs_of(y, 6)
    d = z[left] - z[right]
    loss = lambda w: np.mean(np.logaddexp(0, -(d @ w))) + 0.5e-2 * w @ w
    best = loss(model.weights)
    # no step in any direction is better, nor does plain descent from nothing end lower
    for _ in range(200):
        assert loss(model.weights + rng.normal(size=4) * 10.0 ** rng.uniform(-4, 0)) >= best - 1e-12
    w = np.zeros(4)
    for _ in range(6000):
        w = w - 0.5 * (-(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 1e-2 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    # the cut is the quantile of the scores with most labels on their own side
    strength = z @ model.weights
    right_of = lambda cut: np.mean(strength[y == 1] >= cut) + np.mean(strength[y == 0] < cut)
    assert right_of(model.cut) == max(right_of(c) for c in strength)
    assert ((model.score(x) >= quality.CUT) == (strength >= model.cut)).all()


def test_defined_results(spark):
    docs = spark.createDataFrame([(i, t, "en", 0.3, 7) for i, t in enumerate([*TEXTS, TEXTS[9]])] + [(None, "x y", "en", 0.3, 7)], "doc_id long, text string, lang string, score double, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality.report(docs, none).collect()} == {(0.5, 0)}
    # labels of one kind, of unknown documents, with nulls
    odd = spark.createDataFrame([(0, 1, 0), (1, None, 0), (999, 0, 0), (None, 0, 0), (3, 5, 0)], none.schema)
    assert {r["score"] for r in quality.report(docs, odd).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], none.schema)
    rows = quality.report(docs, labels).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[9] == by_id[11] and by_id[0] == by_id[1]
    assert quality.report(docs.limit(0), labels).count() == 0

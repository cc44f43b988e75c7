"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a vector of surface statistics. From preference pairs (a text
labelled good, a text labelled bad) weights are learned by logistic loss on the
difference of their vectors, so that ``weights . vector`` ranks texts. The cut is
a quantile of the training scores, the one that separates the labels best; scores
are mapped to 0..1 by a logistic curve that is ``CUT`` at that quantile.

The fit takes a bounded, documented sample (``most_rows`` labelled rows, those
with the least hashed ids); every whole text is scored.

Defined results: null and empty texts have the vector of a text without words and
are scored like any other; without labels of both kinds every score is 0.5; equal
texts have equal scores, repeated rows are scored each; labels with a null quality
and labels of unknown documents are not used; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import DARK_BYTES, byte_spans, byte_table, fold_of, mix, sliced, span_hashes, text_bytes

CUT = 0.7
#: Byte classes whose shares are features.
CLASSES = {
    "symbols": byte_table(*[(ord(c), ord(c)) for c in "#*$%&<>@^~=_{}[]\\+/"]),
    "bars": byte_table((124, 124)),
    "shouts": byte_table((33, 33), (63, 63)),
    "capitals": byte_table((65, 90)),
    "digits": byte_table((48, 57)),
    "stops": byte_table((44, 44), (46, 46), (58, 59)),
}
FEATURES = (*CLASSES, "word_length", "log_words", "repeats_next", "repeated_grams", "distinct_words", "repeated_lines", "line_length")


def _shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _repeats(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, how many keys occurred before in the row."""
    _, first = np.unique(mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature vectors of the rows of concatenated UTF-8 texts."""
    n = len(offsets) - 1
    start, end, row = byte_spans(data, offsets, DARK_BYTES)
    words = np.bincount(row, minlength=n)
    dark = np.bincount(row, end - start, minlength=n)
    out = {}
    for name, table in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[name] = np.log(_shares(sums[offsets[1:]] - sums[offsets[:-1]], dark) + 0.01)
    hashes = span_hashes(data, start, end)
    out["word_length"] = np.log(_shares(dark, words) + 1)
    out["log_words"] = np.log(words + 1.0) / 4
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
    out["repeats_next"] = np.log(_shares(np.bincount(row[same], minlength=n), words) + 0.01)
    with np.errstate(over="ignore"):
        grams = mix(hashes[:-2] ^ mix(hashes[1:-1] ^ mix(hashes[2:] + np.uint64(7)))) if len(hashes) > 2 else hashes[:0]
    whole = np.flatnonzero(row[2:] == row[:-2]) if len(hashes) > 2 else np.zeros(0, np.int64)
    out["repeated_grams"] = np.log(_shares(_repeats(grams[whole], row[whole], n), words) + 0.01)
    out["distinct_words"] = np.log1p(-0.99 * _shares(_repeats(hashes, row, n), words)) / np.maximum(out["log_words"], 0.5)
    begin, stop, line = byte_spans(data, offsets, ~byte_table((10, 10)))
    lines = np.bincount(line, minlength=n)
    out["repeated_lines"] = np.log(_shares(_repeats(span_hashes(data, begin, stop), line, n), lines) + 0.01)
    out["line_length"] = np.log(_shares(words, lines) + 1) / 4
    return np.stack([out[f] for f in FEATURES], axis=1)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; CUT at the cut."""
        strength = np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.cut, -60, 60) - np.log(CUT / (1 - CUT))))


def fit(x: np.ndarray, y: np.ndarray, pairs_per_row: int = 24, ridge: float = 1e-3, rounds: int = 25) -> Model | None:
    """Bradley-Terry fit by Newton steps; None unless both labels occur."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / spread, -8, 8)
    draw = np.random.default_rng(0)
    left = np.concatenate([np.repeat(good, pairs_per_row), draw.choice(good, len(bad) * pairs_per_row)])
    right = np.concatenate([draw.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
    d = z[left] - z[right]
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -40, 40)))
        slope = d.T @ p / len(d) - ridge * weights
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ weights
    # every quantile of the training scores is tried; the cut lies half-way to the next score below
    order = np.argsort(strength, kind="stable")
    ranked, is_bad = strength[order], y[order] == 0
    hits = (1 - np.concatenate([[0], np.cumsum(~is_bad)[:-1]]) / len(good)) + np.concatenate([[0], np.cumsum(is_bad)[:-1]]) / len(bad)
    hits[1:][ranked[1:] == ranked[:-1]] = -1
    k = int(hits.argmax())
    at, below = ranked[k], ranked[k - 1] if k else ranked[k] - 2
    return Model(centre, spread, weights, float((at + below) / 2))


_VECTOR = T.ArrayType(T.DoubleType())


def _featured(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", _VECTOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            x = vectors(*text_bytes(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, learn, most_rows: int = 20_000) -> Model | None:
    """Fit on the labelled rows that ``learn`` (a column of doc_id) admits, at most
    about ``most_rows`` of them."""
    usable = labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    count = usable.count()
    if not count:
        return None
    place = F.xxhash64(F.col("doc_id")).bitwiseAND(F.lit((1 << 31) - 1))
    sample = usable.where(place <= int(min(1.0, most_rows / count) * (1 << 31))).limit(2 * most_rows)
    rows = _featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ("y",), "text").toPandas()
    return fit(np.array(rows["x"].tolist()).reshape(-1, len(FEATURES)), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches, "__text"):
            x = vectors(*text_bytes(batch.column(batch.num_columns - 1)))
            found = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found)], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, fold_of("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

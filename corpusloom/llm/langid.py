"""Language ID by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities (forward algorithm); a text's is the
product over its words. Probabilities are fitted by expectation-maximisation on
a bounded sample of labelled rows. Every byte of every text is scored.

Words are runs of ASCII letters and of bytes beyond ASCII, A-Z lower-cased, with
one leading space as in the vocabulary; a run of more than ``CUT`` bytes is
scored in parts of that length.

Defined results: null text, empty text and text without any letter give ``und``
with score 0; without labelled rows every text gives ``und``; equal languages
(ties) resolve to the one that sorts first; repeated rows are scored each;
further columns are ignored by the model and carried along by :func:`predict`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import LETTER_BYTES, LOWER, byte_spans, fold_of, mix, named_back, plainly_named, powers, sliced, span_hashes, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CUT = 96
#: Scale for each byte, so that products over long words stay within doubles.
PER_BYTE = 12.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that words can hold, found by hash: open tables tried in turn."""

    size: int
    longest: int
    tables: tuple[tuple[np.ndarray, np.ndarray, int], ...]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers from 1 on; 0 where there is no such piece."""
        out = np.zeros(len(hashes), np.int32)
        for keys, numbers, turn in self.tables:
            slot = _slots(hashes, turn, len(keys))
            hit = keys[slot] == hashes
            out[hit] = numbers[slot[hit]]
        return out


def _slots(hashes: np.ndarray, turn: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        turned = hashes * np.uint64(2 * turn + 1)
    return (turned >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _tables(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    numbers, turn, size = np.arange(1, len(hashes) + 1, dtype=np.int32), 0, 1 << 18
    while len(hashes):
        slot = _slots(hashes, turn, size)
        _, first = np.unique(slot, return_index=True)
        keys, held = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        keys[slot[first]], held[slot[first]] = hashes[first], numbers[first]
        yield keys, held, turn
        rest = np.ones(len(hashes), bool)
        rest[first] = False
        hashes, numbers, turn, size = hashes[rest], numbers[rest], turn + 1, 1 << 14


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The pieces of a rank file that are an optional space and then word bytes."""
    pieces = []
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            letters = np.frombuffer(piece.removeprefix(b" "), np.uint8)
            if LETTER_BYTES[letters].all() and not ((letters > 64) & (letters < 91)).any():
                pieces.append(piece)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    hashes = span_hashes(data, ends - [len(p) for p in pieces], ends)
    return Vocabulary(len(pieces), int(max(map(len, pieces))), tuple(_tables(hashes)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as byte spans (at most CUT long) of lower-cased data, with their rows."""
    start, end, row = byte_spans(data, offsets, LETTER_BYTES)
    long = end - start > CUT
    if long.any():
        parts = np.where(long, -(-(end - start) // CUT), 1)
        row, first = np.repeat(row, parts), np.repeat(start, parts)
        end = np.repeat(end, parts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first + step * CUT
        end = np.minimum(end, start + CUT)
    return start, end, row


def _grids(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Vocabulary) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Words by length: their places, their length with the space, and for every
    span (from, to) which of them hold a piece there, and which piece."""
    size = end - start
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-2))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for low in range(a, b, 50_000):
            chosen = order[low : min(b, low + 50_000)]
            n = int(size[chosen[0]]) + 1
            grid = np.full((len(chosen), n), 32, np.uint8)
            grid[:, 1:] = data[start[chosen][:, None] + np.arange(n - 1)]
            found = []
            for i in range(n):
                for j in range(i + 1, min(n, i + pieces.longest) + 1):
                    number = pieces.find(_span(grid, i, j - i))
                    if len(hit := np.flatnonzero(number)):
                        found.append((i, j, hit, number[hit]))
            yield chosen, n, found


def _span(grid: np.ndarray, at: int, size: int) -> np.ndarray:
    """Hashes, as :func:`span_hashes` gives them, of bytes [at, at + size) of each row."""
    with np.errstate(over="ignore"):
        return mix((grid[:, at : at + size].astype(np.uint64) + np.uint64(1)) @ powers(size))


def word_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language: (languages, words)."""
    out = np.zeros((len(chances), len(start)))
    scaled = np.concatenate([np.zeros((len(chances), 1)), chances], axis=1)
    for chosen, n, found in _grids(data, start, end, pieces):
        forward = np.zeros((n + 1, len(chances), len(chosen)))
        forward[0] = 1
        for i, j, hit, number in found:
            forward[j][:, hit] += scaled[:, number] * forward[i][:, hit] * PER_BYTE ** (j - i)
        out[:, chosen] = np.log(forward[n]) - n * np.log(PER_BYTE)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    chances: np.ndarray
    vocabulary: str = VOCABULARY


def fit(counts: dict[str, dict[str, int]], path: str = VOCABULARY, rounds: int = 4, floor: float = 0.05) -> Model:
    """Expectation-maximisation from word counts of each language."""
    pieces = vocabulary(path)
    languages = tuple(sorted(counts))
    chances = np.zeros((len(languages), pieces.size))
    for k, language in enumerate(languages):
        words = [w.encode() for w in sorted(counts[language])]
        weight = np.array([counts[language][w.decode()] for w in words], float)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        grids = list(_grids(data, starts, ends, pieces)) if words else []
        chance = np.full(pieces.size + 1, 1.0 / pieces.size)
        chance[0] = 0
        for _ in range(rounds):
            expected = np.zeros(pieces.size + 1)
            for chosen, n, found in grids:
                forward, backward = np.zeros((n + 1, len(chosen))), np.zeros((n + 1, len(chosen)))
                forward[0], backward[n] = 1, 1
                for i, j, hit, number in found:
                    forward[j][hit] += chance[number] * forward[i][hit] * PER_BYTE ** (j - i)
                for i, j, hit, number in reversed(found):
                    backward[i][hit] += chance[number] * backward[j][hit] * PER_BYTE ** (j - i)
                share = weight[chosen] / forward[n]
                for i, j, hit, number in found:
                    expected += np.bincount(number, share[hit] * forward[i][hit] * chance[number] * backward[j][hit] * PER_BYTE ** (j - i), minlength=len(expected))
            expected[1:] += floor
            expected[0] = 0
            chance = expected / expected.sum()
        chances[k] = chance[1:]
    return Model(languages, chances, path)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", path: str = VOCABULARY, docs_per_language: int = 400, words_per_language: int = 150_000, most_words: int = 3_000_000, most_languages: int = 512) -> Model:
    """Fit on a bounded sample: of the rows that ``learn`` admits, about
    ``docs_per_language`` of each language (those whose hashed id falls lowest)
    and of their words the ``words_per_language`` most frequent, of all languages
    together at most ``most_words``. A model has one table of the vocabulary a
    language (0.4 MB), so ``most_languages`` bounds it: those with most rows are
    learned."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_languages).collect()}
    if not sizes:
        return Model((), np.zeros((0, vocabulary(path).size)), path)
    # ids hash to 0..2^31; a language's share of that range holds the sample
    place = F.xxhash64(F.col(doc_id)).bitwiseAND(F.lit((1 << 31) - 1))
    limit = F.coalesce(*[F.when(F.col(lang) == k, F.lit(int(min(1.0, docs_per_language / n) * (1 << 31)))) for k, n in sizes.items()], F.lit(0))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"[a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    words = rows.where(place <= limit).select(F.col(lang).alias("k"), F.explode(found).alias("w")).where(F.octet_length("w") <= CUT)
    order = Window.partitionBy("k").orderBy(F.desc("n"), "w")
    frequent = words.groupBy("k", "w").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= min(words_per_language, max(1, most_words // len(sizes))))
    counts: dict[str, dict[str, int]] = {}
    for r in frequent.select("k", "w", "n").toLocalIterator():
        counts.setdefault(r["k"], {})[r["w"]] = r["n"]
    return fit(counts, path) if counts else Model((), np.zeros((0, vocabulary(path).size)), path)


class Scored:
    """Words that a worker has scored already, by hash: most words of a text have been
    met in earlier ones. Two generations of at most ``most`` numbers together: a word
    that is met moves to the younger one; when that is full the older one is dropped."""

    def __init__(self, model: Model, most: int = 2 << 20):
        self.model, self.most = model, most
        self.young = self.old = (np.zeros(0, np.uint64), np.zeros((len(model.languages), 0)))

    def of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Vocabulary) -> np.ndarray:
        """Log probabilities (languages, words) of words in ascending order of their hashes."""
        out = np.empty((len(self.model.languages), len(hashes)))
        left = np.arange(len(hashes))
        moved = left[:0]
        for held, scores in (self.young, self.old):
            place = np.minimum(np.searchsorted(held, hashes[left]), max(len(held) - 1, 0))
            met = held[place] == hashes[left] if len(held) else np.zeros(len(left), bool)
            out[:, left[met]] = scores[:, place[met]]
            left = left[~met]
            moved = left if held is self.young[0] else moved
        if len(left):
            out[:, left] = word_scores(data, start[left], end[left], pieces, self.model.chances)
        if len(moved):
            held, scores = self.young
            if (len(held) + len(moved)) * (len(out) + 1) > self.most // 2:
                self.old, held, scores = self.young, held[:0], scores[:, :0]
            merged = np.concatenate([held, hashes[moved]])
            order = np.argsort(merged, kind="stable")
            self.young = merged[order], np.concatenate([scores, out[:, moved]], axis=1)[:, order]
        return out


_scored: Scored | None = None


def scored(model: Model) -> Scored:
    """The words that this process has scored with a model."""
    global _scored
    if _scored is None or _scored.model is not model:
        _scored = Scored(model)
    return _scored


def score_batch(data: np.ndarray, offsets: np.ndarray, pieces: Vocabulary, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities (languages, rows) and the number of words of each row."""
    data = LOWER[data]
    start, end, row = words_of(data, offsets)
    rows = len(offsets) - 1
    totals = np.zeros((len(model.languages), rows))
    if len(start):
        hashes, first, place = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        each = scored(model).of(hashes, data, start[first], end[first], pieces)
        for k in range(len(totals)):
            totals[k] = np.bincount(row, each[k][place], minlength=rows)
    return totals, np.bincount(row, minlength=rows) if len(start) else np.zeros(rows, np.int64)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score (the posterior of the prediction
    among the learned languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ascii_letters = LETTER_BYTES.copy()
    ascii_letters[128:] = False
    kept = list(keep)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pieces = vocabulary(model.vocabulary)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in sliced(batches, "__text"):
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            totals, words = score_batch(data, offsets, pieces, model) if model.languages else (np.zeros((1, batch.num_rows)), np.zeros(batch.num_rows))
            best = totals.argmax(axis=0)
            score = 1 / np.exp(totals - totals.max(axis=0)).sum(axis=0)
            marks = np.concatenate([[0], np.cumsum(ascii_letters[data])])
            lettered = marks[offsets[1:]] > marks[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (words > 0)):
                lettered[i] = _has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
            known = lettered & bool(model.languages)
            best[~known], score[~known] = len(model.languages), 0.0
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def learnable(doc_id: str = "doc_id") -> Column:
    return fold_of(doc_id, 3) != 1


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    found = predict(docs, train(docs, learnable(), path=path))
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame, least: float = 0.5, path: str = VOCABULARY) -> DataFrame:
    """Rows whose language is recognised with a posterior of ``least`` or more;
    ``lang`` becomes the recognised language. Where there is nothing to learn from,
    rows with a letter stay as they are."""
    model = train(docs, learnable(), path=path)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    plain, names = plainly_named(docs)
    found = predict(plain, model, text=names["text"], keep=tuple(names.values()))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return named_back(kept, names | {"lang": "lang_pred"})

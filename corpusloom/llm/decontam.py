"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of every ``PICK`` consecutive hashes of
``GRAM``-word grams the least is kept (all equal ones). As GRAM + PICK - 1 is the
window length, any shared window of ``WINDOW`` words shares a fingerprint. The
fingerprints of documents are joined with those of the benchmark; each match is
then extended to the windows around it, which are compared word for word, so no
window is missed and none is invented.

Benchmark items of fewer than ``WINDOW`` words are one window of that length,
found by hashes of grams of exactly that length (winnowing that keeps every gram).

The benchmark is a stated query set. It is taken in blocks of at most
``block_words`` words, whose fingerprints and windows are sorted arrays (some 100 MB
for two million words) that all executors get: a broadcast join on the fingerprint.
Every block is compared with all rows, so memory is bounded whatever the benchmark's
size. Documents are written once if there is more than one block, and a further block
writes only the rows that it hits; these are gathered by row (one entry a block).

Defined results: null and empty texts have no words, no hits and are clean; the
items_sha256 of no items is that of the empty string; items without words and
null items never match, a null item_id counts as the string ``null``; an item_id
that occurs in several rows is one item; repeated documents are judged each;
further columns are carried along or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import LOWER, WORD_BYTES, byte_spans, mix, named_back, plainly_named, scratch, sliced, span_hashes, text_bytes, written

WINDOW, GRAM, PICK = 13, 5, 9
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each word on; NONE where they cross a row's end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * size)
            out ^= out >> np.uint64(31)
    out = mix(out)
    out[rows[:n] != rows[size - 1 :]] = NONE
    return out


def _sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    pick, width = (np.minimum if least else np.maximum), 1
    while width * 2 <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def winnowed(grams: np.ndarray, pick: int = PICK) -> np.ndarray:
    """Marks the grams that are the least of some ``pick`` consecutive ones."""
    if len(grams) < pick:
        return grams != NONE
    least = _sliding(grams, pick, True)
    around = np.concatenate([np.zeros(pick - 1, np.uint64), least, np.zeros(pick - 1, np.uint64)])
    return (grams == _sliding(around, pick, False)) & (grams != NONE)


class Index:
    """Windows and fingerprints of one block of benchmark items, in arrays (some 50 bytes
    a word): built once on the driver, sent to the executors, and joined there by binary
    search."""

    def __init__(self, items: list[tuple[str, str]]):
        bodies = [text.encode("utf-8", "replace") for _, text in items]
        self.data = LOWER[np.frombuffer(b"\n".join(bodies), np.uint8)]
        offsets = np.cumsum([0, *(len(x) + 1 for x in bodies)])
        offsets[-1] = len(self.data)
        self.start, self.end, row = byte_spans(self.data, offsets, WORD_BYTES)
        hashes = span_hashes(self.data, self.start, self.end)
        counts = np.bincount(row, minlength=len(items)) if len(row) else np.zeros(len(items), np.int64)
        self.ids = sorted({name for (name, _), n in zip(items, counts, strict=True) if n})
        number = {name: k for k, name in enumerate(self.ids)}
        of = np.array([number.get(name, -1) for name, _ in items], np.int64)
        size = np.minimum(counts, WINDOW)
        #: for each length: hashes in order, the edges of each one's entries, and these: item, and word at which it has the window
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        #: windows lately met, so that one in many documents is compared once
        self.met: dict[bytes, set[int]] = {}
        prints = []
        for n in sorted({int(x) for x in size if x}):
            grams = gram_hashes(hashes, row, n)
            at = np.flatnonzero((grams != NONE) & (size[row[: len(grams)]] == n))
            self.windows[n] = self._table(grams[at], at, of[row[at]])
            if n == WINDOW:
                short = gram_hashes(hashes, row, GRAM)
                prints.append(short[winnowed(short) & (size[row[: len(short)]] == n)])
            else:
                prints.append(grams[at] ^ np.uint64(n))
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *prints]))
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.prints >> np.uint64(44)).astype(np.int64)] = True

    def words(self, at: int, n: int) -> bytes:
        return spoken(self.data, self.start, self.end, at, n)

    def _table(self, grams: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((item, grams))
        grams, at, item = grams[order], at[order], item[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
        return grams[first], np.append(first, len(grams)), item, at

    def items(self, n: int, gram: np.uint64, words: bytes) -> set[int]:
        """Items that hold the window of n words with this hash."""
        if (found := self.met.get(words)) is None:
            hashes, edges, item, at = self.windows[n]
            k = int(np.searchsorted(hashes, gram))
            here = slice(edges[k], edges[k + 1])
            # one hash is nearly always one window; the words decide all the same
            found = {int(i) for i, w in zip(item[here], at[here], strict=True) if self.words(int(w), n) == words}
            if len(self.met) > 10_000:
                self.met.clear()
            self.met[words] = found
        return found

    def known(self, grams: np.ndarray) -> np.ndarray:
        """The places of grams that are fingerprints of an item."""
        at = np.flatnonzero(self.marks[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
        return at[self.prints[place] == grams[at]]

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length the places where a window may start, and their hashes."""
        for size, (known, *_) in self.windows.items():
            grams = gram_hashes(hashes, rows, size)
            if size == WINDOW:
                short = gram_hashes(hashes, rows, GRAM)
                chosen = np.flatnonzero(winnowed(short))
                at = chosen[self.known(short[chosen])]
                begins = np.unique((at[:, None] - np.arange(PICK)).ravel())
                begins = begins[(begins >= 0) & (begins < len(grams))]
            else:
                begins = self.known(grams ^ np.uint64(size))
            # extended: the whole window's hash is one of the item's windows
            begins = begins[grams[begins] != NONE]
            place = np.minimum(np.searchsorted(known, grams[begins]), len(known) - 1)
            begins = begins[known[place] == grams[begins]] if len(known) else begins[:0]
            yield size, begins, grams[begins]


def spoken(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, n: int) -> bytes:
    """n words from one on, with single blanks."""
    return b" ".join([data[a:b].tobytes() for a, b in zip(start[at : at + n], end[at : at + n], strict=True)])


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of whole items; an item of more words than a block is cut into parts
    that overlap by a window less one word."""
    block, held = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("null")), text)
    for name, body in rows.toLocalIterator():
        data = LOWER[np.frombuffer(body.encode("utf-8", "replace"), np.uint8)]
        start, end, _ = byte_spans(data, np.array([0, len(data)]), WORD_BYTES)
        step = max(block_words, 2 * WINDOW)
        parts = range(0, max(1, len(start) - WINDOW + 1), step)
        for low in parts:
            high = min(len(start), low + step + WINDOW - 1)
            if held and held + high - low > block_words:
                yield block
                block, held = [], 0
            block.append((name, body if len(parts) == 1 else data[start[low] : end[high - 1]].tobytes().decode("utf-8", "replace")))
            held += high - low
    if block:
        yield block


def _merged(first: list[int] | None, more: np.ndarray) -> list[int]:
    """Union of hit word numbers as alternating starts and ends."""
    known = [np.arange(a, b) for a, b in zip((first or [])[::2], (first or [])[1::2], strict=True)]
    hit = np.unique(np.concatenate([*known, more])) if known or len(more) else more
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) != 1)
    return np.stack([hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])] + 1], axis=1).ravel().tolist()


def _found(index: Index, batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, dict[int, list[np.ndarray]], dict[int, set[int]]]:
    """Words of each row, and for rows with a hit its word numbers and items."""
    data, offsets = text_bytes(batch.column(text))
    data = LOWER[data]
    start, end, row = byte_spans(data, offsets, WORD_BYTES)
    firsts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    hits: dict[int, list[np.ndarray]] = {}
    met: dict[int, set[int]] = {}
    for size, begins, grams in index.candidates(span_hashes(data, start, end), row) if len(start) else ():
        for i, gram in zip(begins, grams, strict=True):
            if got := index.items(size, gram, spoken(data, start, end, i, size)):
                r = int(row[i])
                hits.setdefault(r, []).append(np.arange(i, i + size) - firsts[r])
                met.setdefault(r, set()).update(got)
    return np.diff(firsts), hits, met


_SPANS, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _pass(docs: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """Adds to the columns (the last is the text) __n, and one block's hits: __spans, __items."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n", T.LongType()), T.StructField("__spans", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))])
    names = [*docs.columns, "__n", "__spans", "__items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in sliced(batches, "__text"):
            n, hits, met = _found(index, batch, batch.num_columns - 1)
            spans = [_merged(None, np.concatenate(hits[r])) if r in hits else None for r in range(batch.num_rows)]
            found = [sorted(index.ids[k] for k in met[r]) if r in met else None for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, _ITEMS)], names=names)

    return docs.mapInArrow(run, schema)


def _further(rows: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """__id, __more (spans), __met of the rows (__id, __text) that a further block hits."""
    shared = rows.sparkSession.sparkContext.broadcast(Index(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in sliced(batches, "__text"):
            _, hits, met = _found(index, batch, 1)
            at = sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([_merged(None, np.concatenate(hits[r])) for r in at], _SPANS), pa.array([sorted(index.ids[k] for k in met[r]) for r in at], _ITEMS)], names=["__id", "__more", "__met"])

    return rows.mapInArrow(run, "__id long, __more array<long>, __met array<string>")


def _united(frame: DataFrame) -> DataFrame:
    """Spans and items of the first block with those of further ones (__others)."""
    names = frame.columns
    spans, found, others = (names.index(c) for c in ("__spans", "__items", "__others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            more = columns.pop(others).to_pylist()
            was, had = columns[spans].to_pylist(), columns[found].to_pylist()
            for r, x in enumerate(more):
                for other in x or ():
                    was[r] = _merged(was[r], np.concatenate([np.arange(a, b) for a, b in zip(other["s"][::2], other["s"][1::2], strict=True)]))
                    had[r] = sorted({*(had[r] or ()), *other["i"]})
            columns[spans], columns[found] = pa.array(was, _SPANS), pa.array(had, _ITEMS)
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n != "__others"])

    return frame.mapInArrow(run, T.StructType([f for f in frame.schema.fields if f.name != "__others"]))


def match(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """``keep`` columns with n_words, spans (hit words as alternating starts and
    ends), items (ids of items with occurring windows) and n_hit."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    blocks = _blocks(benchmark, item, item_text, block_words)
    frame = _pass(rows, next(blocks, []))
    if (block := next(blocks, None)) is not None:
        # texts are written once; what a further block adds is a row for each document that it hits
        frame = written(frame.withColumn("__id", F.monotonically_increasing_id()), "first-block")
        folder, k = scratch(spark, "blocks"), 1
        while block is not None:
            _further(frame.select("__id", "__text"), block).write.parquet(f"{folder}/block={k}")
            block, k = next(blocks, None), k + 1
        more = spark.read.schema("__id long, __more array<long>, __met array<string>").parquet(folder)
        more = more.groupBy("__id").agg(F.collect_list(F.struct(F.col("__more").alias("s"), F.col("__met").alias("i"))).alias("__others"))
        frame = _united(frame.join(written(more, "further-blocks"), "__id", "left").drop("__id"))
    spans, found = F.coalesce("__spans", F.array().cast("array<long>")), F.coalesce("__items", F.array().cast("array<string>"))
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return frame.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").alias("n_words"), spans.alias("spans"), found.alias("items"), n_hit.alias("n_hit"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    return match(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated."""
    plain, names = plainly_named(docs)
    found = match(plain, benchmark, keep=tuple(names.values()), text=names["text"])
    return named_back(found.where(~contaminated()), names)


REPORT_SQL = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, abc),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, abc),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
       FROM d, (SELECT DISTINCT size FROM bw) s, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hit AS (SELECT doc_id, item, dw.size, i FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

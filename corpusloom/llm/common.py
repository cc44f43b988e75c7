"""Shared plumbing: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python worker holds at a time
#: (a single longer text is taken alone).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is unset a temporary folder is made and set as the checkpoint
    folder of the context, in local mode only; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written with :func:`written`. For the end of a
    job: frames that stand on it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it
    back. Lost executors cost no recomputation of what stands above."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plainly_named(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that clash with none of an operator's own, and the new
    name of each old one, in order."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def fold_of(column: Column | str, modulus: int) -> Column:
    """The fold of a row: crc32 of the id as text, modulo ``modulus`` (null ids: fold -1)."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(text.cast("string").cast("binary")) % modulus, F.lit(-1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, high - low, low) if data is not None and high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def sliced(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``most`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17
_pow = _inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        _pow, _inv = (np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        for weights in (_pow, _inv):
            weights[0] = 1
            np.cumprod(weights, out=weights)
    return _pow, _inv


def powers(n: int) -> np.ndarray:
    """The first n weights of a span's bytes in :func:`span_hashes`."""
    return _powers(n)[0][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) in ascending order of start;
    equal bytes hash equally wherever they stand."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = int(start[i])
            j = max(i + 1, int(np.searchsorted(start, base + _BLOCK)))
            top = int(end[i:j].max())
            power, inverse = _powers(max(_BLOCK, top - base) + 1)
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * power[: top - base], out=sums[1:])
            low, high = start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[high] - sums[low]) * inverse[low]
            i = j
    return mix(out)


def byte_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that ``table`` marks, never over a row's end:
    starts, ends and rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that digits, ASCII letters and all other letters and signs beyond ASCII form.
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER_BYTES = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
DARK_BYTES = ~byte_table((0x20, 0x20), (0x09, 0x0D))

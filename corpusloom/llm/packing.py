"""Best-fit packing of documents into training sequences of several lengths.

Variable-capacity best fit: items in falling order go to the open bin in which
they leave the least room, whatever its size; where none fits, the bin size of
least cost a token that holds the item is opened; when all is placed, every bin is
downsized to the least-cost size that holds its contents. A sequence costs its
length, a fixed overhead, and attention that grows with the square of its length.

Documents longer than the largest size are cut into parts of that size and a rest;
no token is lost. Lengths are packed in shards of about ``shard_rows`` rows dealt
by hash, so that each task sorts a bounded number of integers; texts don't move.

Defined results: documents without tokens (null, empty) need no room: one row with
part 0 and no bin; ties in length go by doc_id and then by place in the table;
repeated rows are packed each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.common import written

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, SQUARE = 64.0, 1 / 65536


def cost(size: int) -> float:
    """Cost of a sequence of a permitted length."""
    return size + OVERHEAD + SQUARE * size * size


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Packs lengths (falling, each from 1 to the largest size): the bin and the
    offset of each, and the final size of each bin."""
    sizes = sorted(sizes)
    by_rate = sorted(sizes, key=lambda c: (cost(c) / c, c))
    opened = {}
    for need in range(len(sizes)):
        # for items over sizes[need - 1] and up to sizes[need]
        opened[sizes[need]] = next(c for c in by_rate if c >= sizes[need])
    free: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    rooms = 0  # bit r: some bin has exactly r free
    bins, offsets, room, filled = [], [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                rooms &= ~(1 << left)
        else:
            step = next(c for c in sizes if c >= length)
            b, left = len(room), opened[step]
            room.append(0)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += length
        rest = room[b] = left - length
        if rest:
            free[rest].append(b)
            rooms |= 1 << rest
    cheapest = {c: min((d for d in sizes if d >= c), key=cost) for c in sizes}
    return bins, offsets, [cheapest[next(c for c in sizes if c >= f)] for f in filled]


def packed(lengths: DataFrame, length: str = "n_tokens", doc_id: str = "doc_id", sizes: Sequence[int] = SIZES, shard_rows: int = 8192) -> DataFrame:
    """``lengths``: one row a document with its number of tokens (a written table).
    Returns doc_id, part, start, part_tokens, bin, bin_size, offset; the bin is
    unique over all shards."""
    most = max(sizes)
    shards = max(1, -(-lengths.count() // shard_rows))
    place = F.monotonically_increasing_id()
    rows = lengths.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), place.alias("row"))
    parts = rows.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0).cast("long")))).alias("part"))
    parts = parts.select("doc_id", "row", "part", (F.col("part") * most).alias("start"), F.least(F.col("n") - F.col("part") * most, F.lit(most)).alias("part_tokens"))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("row", "part"), F.lit(shards)))
    kind = lengths.schema[doc_id].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part_tokens", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("part", "ascending")])
        bins, offsets, final = pack(rows["part_tokens"].to_pylist(), sizes)
        first = rows["shard"][0].as_py() << 32
        columns = {c: rows[c] for c in ("doc_id", "part", "start", "part_tokens")}
        more = {"bin": [first + b for b in bins], "bin_size": [final[b] for b in bins], "offset": offsets}
        return pa.table({**columns, **{k: pa.array(v, pa.int64()) for k, v in more.items()}})

    out = f"doc_id {kind}, part long, start long, part_tokens long, bin long, bin_size long, offset long"
    placed = parts.where("part_tokens > 0").groupBy("shard").applyInArrow(run, out)
    none = parts.where("part_tokens <= 0").select("doc_id", "part", "start", "part_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bin", "bin_size", "offset")])
    return placed.unionByName(none)


def lengths_of(docs: DataFrame, path: str = tokens.RANKS) -> DataFrame:
    return written(tokens.counted(docs, ("doc_id",), path=path), "lengths")


def report(docs: DataFrame, path: str = tokens.RANKS) -> DataFrame:
    """Where each part of every document lies."""
    return packed(lengths_of(docs, path))


stage = report


def padding(packs: DataFrame) -> DataFrame:
    """Sequences, tokens and padding by sequence length of a packing."""
    bins = packs.where(F.col("bin").isNotNull()).groupBy("bin", "bin_size").agg(F.sum("part_tokens").alias("tokens"))
    return bins.groupBy("bin_size").agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), (F.sum("bin_size") - F.sum("tokens")).alias("padding"))

"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``BITS`` differing bits are linked. Of the three blocks of a
fingerprint's bits, a linked pair agrees in one at least, so every distinct
fingerprint enters three groups, one for each block's shared pattern (the upper
nodes of the index). Within a group fingerprints are sorted by Gray rank and
folded into nodes that hold the bits on which all their members agree; nodes fold
into nodes again. Pairs of nodes whose agreed bits already differ in more than
``BITS`` places are pruned as a whole, the others are opened down to members.

Exact copies are one fingerprint before anything is compared. A group of more
than ``group_most`` distinct fingerprints is not gathered in one task: it becomes an
upper node, and its members enter three lower groups each, by its pattern and one
more block of the bits that are left (again, a linked pair agrees in one of three).
After three such levels at most 16 bits are left, and with them at most 65,536 members,
so no group is unbounded and no link is lost.

Groups give a spanning forest of their links, not all pairs; connected components
over these have the same members.

Defined results: texts without words (null, empty, only white space) have
fingerprint zero and link with each other; texts of one or two words have one
shingle, the whole sequence; equal rows fall in one component; null doc_ids take
part with component ids of the non-null rest (null if there is none); of each
component one row is kept by :func:`stage`, whatever ids are null or repeated; further
columns are carried by it and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import MASK, named_back, plainly_named, sliced, written
from corpusloom.llm.components import connected_components

BITS, SHINGLE, SEED = 2, 3, 42
LEAF, FAN = 16, 16
#: Blocks of a fingerprint's bits, as signed longs: one more than BITS.
BLOCKS = ((1 << 22) - 1, ((1 << 21) - 1) << 22, -(1 << 43))
#: Shingles hashed at a time, which bounds memory on very long texts.
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for low in range(0, max(1, len(words) - SHINGLE + 1), _STEP):
        part = words[low : low + _STEP + SHINGLE - 1]
        if len(part) <= SHINGLE:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(b" ".join(x), SEED) for x in zip(part, part[1:], part[2:], strict=False)]
        total += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``fp`` (the fingerprint's bits as a signed long)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found)], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def gray_rank(value):
    """Place of a fingerprint in Gray order, as a column that sorts like unsigned numbers."""
    for step in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, step))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each link one label, the least of their trees."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def group_labels(values: np.ndarray) -> np.ndarray:
    """Labels (least place) of the linked members of one group of fingerprints in Gray order."""
    label = np.arange(len(values))
    levels, agreed, shared = [], values, np.full(len(values), np.uint64(0xFFFFFFFFFFFFFFFF))
    for size in (LEAF, *[FAN] * 16):
        first = np.arange(0, len(agreed), size)
        differ = np.bitwise_or.reduceat((agreed ^ np.repeat(agreed[first], np.diff([*first, len(agreed)]))) | ~shared, first)
        agreed, shared = agreed[first], ~differ
        levels.append((agreed, shared))
        if len(agreed) <= FAN:
            break
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 4096:
            stack += [(level, i[4096:], j[4096:]), (level, i[:4096], j[:4096])]
            continue
        bits, mask = levels[level]
        near = np.bitwise_count((bits[i] ^ bits[j]) & mask[i] & mask[j]) <= BITS
        i, j = i[near], j[near]
        below = LEAF if level == 0 else FAN
        count = len(values) if level == 0 else len(levels[level - 1][0])
        if level == 0 and len(i):
            low = np.minimum.reduceat(label, np.arange(0, len(values), LEAF))
            high = np.maximum.reduceat(label, np.arange(0, len(values), LEAF))
            done = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
            i, j = i[~done], j[~done]
        if not len(i):
            continue
        a = (i[:, None, None] * below + np.arange(below)[:, None]).repeat(below, axis=2).ravel()
        b = (j[:, None, None] * below + np.arange(below)[None, :]).repeat(below, axis=1).ravel()
        kept = (a < count) & (b < count) & (a <= b)
        a, b = a[kept], b[kept]
        if level:
            stack.append((level - 1, a, b))
        else:
            near = np.bitwise_count(values[a] ^ values[b]) <= BITS
            _unite(label, a[near], b[near])
    return label


def _links(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links of each group; rows come sorted by group and Gray rank."""

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        mask, pattern, values = (rows[c].to_numpy() for c in ("mask", "pattern", "fp"))
        fresh = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]))
        sizes = np.diff([*fresh, len(values)])
        fps = values.astype(np.uint64)
        label = np.arange(len(values))
        small = sizes <= LEAF
        group = np.repeat(np.arange(len(sizes)), sizes)
        for lag in range(1, min(LEAF, int(sizes.max(initial=1)))):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & small[group[lag:]])
            i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= BITS]
            _unite(label, i, i + lag)
        for low, size in zip(fresh[~small], sizes[~small], strict=True):
            label[low : low + size] = low + group_labels(fps[low : low + size])
        linked = np.flatnonzero(label != np.arange(len(values)))
        return pd.DataFrame({"u": values[linked], "v": values[label[linked]]})

    rest = None
    for rows in groups:
        if not len(rows):
            continue
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        mask, pattern = rows["mask"].to_numpy(), rows["pattern"].to_numpy()
        same = (mask == mask[-1]) & (pattern == pattern[-1])
        cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield forest(rows.iloc[:cut])
        rest = rows.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield forest(rest)


def finer(mask: int) -> list[int]:
    """The masks (signed longs) that share the bits of ``mask`` and one more block each of
    the others: two fingerprints that agree on ``mask`` and are linked agree on one of these."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(rest) / (BITS + 1)) for k in range(BITS + 2)]
    made = [mask & MASK | sum(1 << b for b in rest[low:high]) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def links(nodes: DataFrame, group_most: int = 1 << 16) -> DataFrame:
    """Links u, v among the distinct fingerprints ``fp`` of ``nodes`` that join the
    same ones as all pairs within BITS bits would."""
    masks, level, found = list(BLOCKS), 0, None
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    while True:
        level += 1
        # where 16 bits are left, a group has 65,536 members at most
        last = 64 - min((m & MASK).bit_count() for m in masks) <= 16
        crowded = None if last else written(keyed.groupBy("mask", "pattern").count().where(F.col("count") > group_most).select("mask", "pattern"), f"crowded-{level}")
        if crowded is not None and not crowded.take(1):
            crowded = None
        plain = keyed if crowded is None else keyed.join(crowded, ["mask", "pattern"], "left_anti")
        plain = plain.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
        here = plain.mapInPandas(_links, "u long, v long")
        found = here if found is None else found.unionByName(here)
        if crowded is None:
            return found
        # lower nodes of the index: a crowded group's pattern and one more block
        steps = [(m, f) for m in masks for f in finer(m)]
        below, masks = nodes.sparkSession.createDataFrame(steps, "mask long, finer long"), sorted({f for _, f in steps})
        members = keyed.join(crowded, ["mask", "pattern"], "left_semi").join(F.broadcast(below), "mask")
        keyed = written(members.select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("pattern")).distinct(), f"finer-{level}")


def _labelled(prints: DataFrame, doc_id: str, group_most: int) -> DataFrame:
    """fp, first (its least doc_id) and root of each distinct fingerprint of ``prints``."""
    nodes = written(prints.groupBy("fp").agg(F.min(doc_id).alias("first")), "fingerprints")
    roots = connected_components(links(nodes.select("fp"), group_most))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(prints: DataFrame, doc_id: str = "doc_id", group_most: int = 1 << 16) -> DataFrame:
    """fp, component_id (least doc_id reachable) of each distinct fingerprint of ``prints``."""
    labelled = _labelled(prints, doc_id, group_most)
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(least, "root").select("fp", "component_id")


def survivors(prints: DataFrame, group_most: int = 1 << 16) -> DataFrame:
    """first and fp of one row of each component: the least doc_id (null only where the
    component has no other), then the least fingerprint."""
    best = _labelled(prints, "doc_id", group_most).groupBy("root").agg(F.min(F.struct(F.isnull("first").alias("none"), "first", "fp")).alias("best"))
    return best.select("best.first", "best.fp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row."""
    prints = written(fingerprints(docs), "prints")
    found = prints.join(components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """One row of each component: the one of the least doc_id (of rows with equal ids
    and fingerprints one). A null or repeated id stands for several rows, of which
    the fingerprint tells the survivors."""
    prints = written(fingerprints(docs), "prints")
    first = written(survivors(prints), "survivors")
    twice = written(prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")), "repeated-ids")
    plain, names = plainly_named(docs)
    own = F.col(names["doc_id"])
    chosen = plain.join(first.where("first IS NOT NULL").select("first"), own == F.col("first"), "left_semi")
    unsure = []
    if twice.take(1):
        unsure.append(chosen.join(twice, own == F.col("twice"), "left_semi"))
        chosen = chosen.join(twice, own == F.col("twice"), "left_anti")
    if first.where("first IS NULL").take(1):
        unsure.append(plain.where(own.isNull()))
    for rows in unsure:
        known = fingerprints(rows, names["text"], tuple(names.values()))
        told = known.join(first.withColumnRenamed("fp", "__fp"), own.eqNullSafe(F.col("first")) & (F.col("fp") == F.col("__fp")), "left_semi")
        chosen = chosen.unionByName(told.dropDuplicates([names["doc_id"], "fp"]).drop("fp"))
    return named_back(chosen, names)

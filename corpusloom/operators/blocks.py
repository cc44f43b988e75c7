"""The best k of a search without scoring every posting of a frequent term.

Postings are kept a second time in blocks of falling score: what a posting contributes
grows with one number, its ratio of frequency to length, so a term's block holds the
postings within an eighth of a doubling of it, and its greatest contribution is known
from the block's number and the query alone. A table counts the postings of each block.

A request goes in three steps. The blocks on top of each term give documents of which k
reach some score, the floor. Blocks are then left unread, lowest first, while what a
document may have in all unread ones together stays below the floor, so no document above
it is missed. Of the documents met, those that could reach the floor with what is unread
are scored in full, from the postings in order of documents. Ties of the k-th stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.index import Index
from corpusloom.operators.tables import written

#: Blocks for each doubling of a posting's ratio; relative room for rounding.
STEPS, ROOM = 8, 1e-9
#: Candidates up to this number are named in the filter of the scan; more are joined.
NAMED = 128

#: (place of the query's token, term, weight) of a variant.
Weighted = tuple[int, str, float]


def ratio(avg_len: float, b: float) -> Column:
    """What a posting's score grows with: frequency by length."""
    return F.col("wtf") / 10.0 / (F.lit(1.0 - b) + b * F.col("n_tokens") / F.lit(avg_len))


def impacts(index: Index, b: float) -> tuple[DataFrame, DataFrame]:
    """Postings with ``block``, in ranges of term and falling block; and term, block, n.
    Built when first asked for. Both are sorted, so filters skip files and row groups."""
    if index.impacts is None:
        rows = index.postings.withColumn("block", F.floor(F.log2(ratio(index.avg_len, b)) * STEPS).cast("int"))
        order = ["term", F.desc("block"), "skill_id"]
        held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order), "impacts")
        counts = held.groupBy("term", "block").agg(F.count("*").alias("n"))
        index.impacts = held, written(counts.repartitionByRange("term").sortWithinPartitions("term"), "maxima")
    return index.impacts


def reached(weight: float, block: int, k1: float) -> tuple[float, float]:
    """The least and the greatest contribution of a block's postings, with room for rounding."""
    low, high = (weight * (k1 + 1.0) * r / (r + k1) for r in (2.0 ** (block / STEPS), 2.0 ** ((block + 1) / STEPS)))
    return low * (1 - ROOM), high * (1 + ROOM)


def unread(levels: list[list[tuple[float, int]]], floor: float) -> list[int]:
    """How many of each token's blocks, given as (greatest contribution, postings) from the
    lowest up, are left unread so that the greatest of each token's unread ones sum to less
    than ``floor``; by most postings for the room they take."""
    taken, spent = [0] * len(levels), 0.0
    while True:
        best: tuple[float, int, int, float] | None = None
        for j, rows in enumerate(levels):
            saved, base = 0, rows[taken[j] - 1][0] if taken[j] else 0.0
            for i in range(taken[j], len(rows)):
                saved, extra = saved + rows[i][1], rows[i][0] - base
                if spent + extra >= floor:
                    break
                gain = saved / extra if extra > 0 else math.inf
                if best is None or gain > best[0]:
                    best = gain, j, i + 1, extra
        if best is None:
            return taken
        taken[best[1]], spent = best[2], spent + best[3]


def _met(held: DataFrame, wanted: dict[Weighted, int], avg_len: float, k1: float, b: float) -> DataFrame:
    """skill_id, place, s: each document's best contribution for each token from blocks
    of at least the given number."""
    # a term of several tokens is read from the lowest block that any of them wants
    blocks = [(F.col("term") == v[1]) & (F.col("block") >= least) for v, least in wanted.items()]
    few = held.sparkSession.createDataFrame([(*v, least) for v, least in wanted.items()], "place int, term string, weight double, least int")
    r = ratio(avg_len, b)
    # variants of one request
    rows = held.where(reduce(Column.__or__, blocks)).join(F.broadcast(few), "term").where("block >= least")
    return rows.groupBy("skill_id", "place").agg(F.max(F.col("weight") * (k1 + 1.0) * r / (r + k1)).alias("s"))


def _floor(sums: DataFrame, k: int) -> float:
    """The k-th greatest ``low``; 0 where there are fewer."""
    top = sums.select("low").orderBy(F.desc("low")).limit(k).collect()
    return top[-1]["low"] if len(top) == k else 0.0


def leading(index: Index, found: list[Weighted], k: int, k1: float, b: float) -> DataFrame:
    """The postings, for the terms of a request, of all documents whose score reaches the
    k-th greatest, and of few others. With less than k documents, of all."""
    terms = sorted({t for _, t, _ in found})
    everything = index.postings.where(F.col("term").isin(terms))
    held, maxima = impacts(index, b)
    # some hundred blocks a term at most, whatever the corpus: a ratio doubles 50 times at most
    counts: dict[str, list[tuple[int, int]]] = {}
    for row in maxima.where(F.col("term").isin(terms)).collect():
        counts.setdefault(row["term"], []).append((row["block"], row["n"]))
    floor, top = 0.0, {}
    for v in found:
        seen = 0
        for block, n in sorted(counts.get(v[1], ()), reverse=True):
            top[v], seen = block, seen + n
            if seen >= k:
                floor = max(floor, reached(v[2], block, k1)[0])
                break
    if not top:
        return everything
    floor = max(floor, _floor(_met(held, top, index.avg_len, k1, b).groupBy("skill_id").agg(F.sum("s").alias("low")), k) * (1 - ROOM))
    if floor <= 0:
        return everything
    places = sorted({v[0] for v in top})
    blocks = [sorted((reached(v[2], block, k1)[1], n, v, block) for v in top if v[0] == p for block, n in counts[v[1]]) for p in places]
    skipped = unread([[x[:2] for x in rows] for rows in blocks], floor)
    if not any(skipped):
        return everything
    most = {p: rows[n - 1][0] if n else 0.0 for p, rows, n in zip(places, blocks, skipped, strict=True)}
    wanted: dict[Weighted, int] = {}
    for rows, n in zip(blocks, skipped, strict=True):
        for _, _, v, block in rows[n:]:
            wanted[v] = min(wanted.get(v, block), block)
    room = F.create_map(*[F.lit(x) for p in places for x in (p, most[p])])[F.col("place")]
    sums = _met(held, wanted, index.avg_len, k1, b).groupBy("skill_id").agg(F.sum("s").alias("low"), (F.sum(F.greatest("s", room) - room) + sum(most.values())).alias("high"))
    sums = written(sums.where(F.col("high") >= floor * (1 - ROOM)), "candidates")
    floor = max(floor, _floor(sums, k) * (1 - ROOM))
    chosen = sums.where(F.col("high") >= floor * (1 - ROOM)).select("skill_id")
    few = [r["skill_id"] for r in chosen.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        # each an equality, so that pages of postings without any of them are skipped
        return everything.where(reduce(Column.__or__, [F.col("skill_id") == x for x in few], F.lit(False)))
    return everything.join(chosen, "skill_id", "left_semi")

"""Bodies in order while they fit a budget; one that doesn't fit is skipped.

A fold of this kind looks sequential, but what is left of the budget tells most of it:
while at least 2^k is left and less than twice that, all bodies shorter than 2^k fit,
and at most one of the longer ones is taken, after which less than 2^k is left. So a
pass looks, after the place where the last one ended, for the first of two events: the
running sum of the short bodies leaves less than 2^k, or a longer body fits. Each pass
at least halves what is left, and bodies that are longer than that drop out for good.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import numbered

#: Places over which a running sum is taken in one window.
CHUNK = 1 << 16


def _event(rows: DataFrame, after: int, left: int, short: int, chunk: int) -> tuple[int, int] | None:
    """The first place beyond ``after`` where less than ``short`` is left, or a body of
    at least that size fits, and what is left then."""
    live = rows.where((F.col("place") > after) & (F.col("n") > 0) & (F.col("n") <= left)).withColumn("part", F.expr(f"place div {chunk}"))
    live = live.withColumn("small", F.when(F.col("n") < short, F.col("n")).otherwise(0))
    sums = live.groupBy("part").agg(F.sum("small").alias("of"))
    # a row for each chunk
    sums = sums.select("part", F.coalesce(F.sum("of").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = live.withColumn("run", F.sum("small").over(within)).join(sums, "part").withColumn("rest", left - F.col("before") - F.col("run"))
    # a body that isn't short is still to be paid for
    event = run.where(F.when(F.col("n") < short, F.col("rest") < short).otherwise(F.col("rest") >= F.col("n")))
    found = event.agg(F.min_by(F.struct("place", (F.col("rest") - F.when(F.col("n") < short, 0).otherwise(F.col("n"))).alias("rest")), "place").alias("e")).first()["e"]
    return tuple(found) if found else None


def fold(rows: DataFrame, budget: int, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (written: place, counted from 1 or more, n and more) with ``included``:
    null where n is 0, all others where ``budget`` is not positive."""
    taken: list[Column] = []
    after, left = 0, budget
    place, n = F.col("place"), F.col("n")
    while left > 0:
        short = 1 << (left.bit_length() - 1)
        event = _event(rows, after, left, short, chunk)
        # short bodies up to the event, at which the body is taken or is the last short one
        until = F.lit(True) if event is None else place < event[0]
        taken.append((place > after) & (n < short) & until)
        if event is None:
            break
        taken.append(place == event[0])
        after, left = event
    fits = F.lit(True) if budget <= 0 else reduce(Column.__or__, taken)
    return rows.withColumn("included", F.when(n > 0, fits))


def budget_fold(entries: DataFrame, order: Sequence[Column], body: str, budget: int, chunk: int = CHUNK) -> DataFrame:
    """name, place, included of ``entries``: only names, lengths and what orders them
    are shuffled. Empty bodies count neither way (included is null)."""
    return sized_fold(entries, order, F.char_length(F.coalesce(F.col(body), F.lit(""))), budget, chunk)


def sized_fold(entries: DataFrame, order: Sequence[Column], size: Column, budget: int, chunk: int = CHUNK) -> DataFrame:
    """:func:`budget_fold` for entries that hold the length of their body instead of it."""
    keys = [f"o{i}" for i in range(len(order))]
    thin = entries.select("name", size.cast("long").alias("n"), *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    return fold(numbered(thin, keys, name="budget"), budget, chunk).select("name", "place", "included")

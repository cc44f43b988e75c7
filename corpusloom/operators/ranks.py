"""Places of rows in a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written

#: Bits that a row's number within its partition takes in ``monotonically_increasing_id``.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), column: str = "place", first: int = 1, total: str | None = None, name: str = "numbered") -> DataFrame:
    """``df`` with ``column``: the place of each row in ``order`` among the rows that
    share the columns ``within`` (nulls are one group), counted from ``first``; and,
    where it is named, ``total``, the number of these rows.

    Rows are partitioned by ranges of (within, order) and sorted there; a partition
    then says how many rows of each group it has, and the sum over earlier partitions
    is added to a row's own place. However large a group is, it spreads over as many
    partitions as it fills. What is gathered is one row for each partition and group.
    Rows that are equal in ``order`` get consecutive places in no set order, so
    ``order`` should be total. The sorted rows are written to the shared folder.
    """
    cols = [*within, *order]
    at, part = F.col("__at"), F.shiftright("__at", _ROW_BITS).alias("__part")
    rows = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()), name)
    keys = [F.col(c).alias(f"__w{i}") for i, c in enumerate(within)]
    names = [f"__w{i}" for i in range(len(within))]
    parts = rows.groupBy(*keys, part).agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    group = Window.partitionBy(*names)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low") + first
    parts = written(parts.select(*names, "__part", before.alias("__before"), F.sum("__n").over(group).alias("__total")), f"{name}-parts")
    same = F.shiftright(at, _ROW_BITS) == F.col("__part")
    for c, n in zip(within, names, strict=True):
        same &= rows[c].eqNullSafe(F.col(n))
    # without groups it is one row for each partition, whose number the session sets
    placed = rows.join(parts if within else F.broadcast(parts), same)
    found = [(at + F.col("__before")).alias(column), *([F.col("__total").alias(total)] if total else [])]
    return placed.select(*[rows[c] for c in df.columns], *found)

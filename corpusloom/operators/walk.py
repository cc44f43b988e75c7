"""Composition with recommendations: a walk whose outcome depends on its order.

A queue takes documents in the order in which their labels (reason, depth, via) got
better: a stronger reason beats a smaller depth beats a via that comes first in
language order. A document whose label is no longer its own when its turn comes is
passed over; the others offer a label to all that they relate to.

The queue goes by generations: what is offered in generation g has depth g + 1. So
within a generation an offer is accepted by reason alone, the last one accepted is the
best one, and its place in the offers' order is the document's place in the next
generation. What remains of the order inside a generation is this: a recommended
document is passed over where an earlier one, which is not passed over itself, requires
it. That is settled in rounds, each of which settles at least all that depend on no
other document in doubt.

A document that was opened as recommended and is opened again as required offers what it
offered before, at a greater depth, so nobody accepts it: it takes no part in the front
again, and only the missing relations that it meets again are added at the end.

All of it is joins and groups on names, whose rows are aggregated before they meet. A
front of few rows goes to all tasks, so that relations and labels stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ranks import numbered
from corpusloom.operators.tables import shuffled, written

REASONS = {"seed": 3, "required": 2, "recommended": 1}
#: Generations after which what was gathered is written as one table.
REWRITE = 8
#: Places may grow to this before they are counted anew.
MOST_PLACES = 1 << 60
#: Rows of a front, or of its offers, that go to all tasks.
FEW = 20_000


def reason_of(strength: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for r, n in REASONS.items() for x in (n, r)]), strength)


def _near(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows for a join with relations or labels, which stay in place where these are few."""
    return F.broadcast(rows) if n <= FEW else shuffled(rows)


def _counted(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` written, and ``counts`` of them that are taken on the way, without a job."""
    found = Observation()
    out = written(rows.observe(found, *[c.alias(k) for k, c in counts.items()]), name)
    return out, found.get


def passed_over(offers: DataFrame) -> DataFrame:
    """v: who is passed over of those that an earlier document of their generation requires
    (``offers``, written: via, to_name, early)."""
    doubt, passed = written(offers.where("early").select(F.col("via").alias("u"), F.col("to_name").alias("v")).distinct(), "doubt"), None
    while doubt.take(1):
        # who is required by nobody in doubt is opened, and whom they require is passed over
        over = written(doubt.join(doubt.select(F.col("v").alias("u")).distinct(), "u", "left_anti").select("v").distinct(), "passed")
        passed = over if passed is None else passed.unionByName(over)
        doubt = written(doubt.join(over, "v", "left_anti").join(over.withColumnRenamed("v", "u"), "u", "left_anti"), "doubt")
    return passed


def walk(edge_rows: DataFrame, seeds: list[str], most_places: int = MOST_PLACES) -> tuple[DataFrame, DataFrame]:
    """Entries (name, reason, depth, via) of all that ``seeds`` lead to by requirements
    and recommendations, and the missing relations met (name, relation, via, depth).

    A place in a generation is the place of who offers times the greatest number of
    relations of a document, plus the relation's number: comparable without sorting.
    When it could exceed ``most_places`` the generation is numbered from 0 by ranges."""
    spark = edge_rows.sparkSession
    required = F.col("relation") == "requires"
    strength = F.when(required, REASONS["required"]).otherwise(REASONS["recommended"])
    wide = (edge_rows.agg(F.max("pos")).first()[0] or 0) + 1
    # a document's requirements come before its recommendations
    at = F.col("pos").cast("long") + F.when(required, 0).otherwise(wide)
    known = written(edge_rows.where("to_name is not null").select(F.col("from_name").alias("via"), "to_name", strength.alias("strength"), at.alias("at")), "relations")
    first = list(dict.fromkeys(seeds))
    live = spark.createDataFrame([(s, i, REASONS["seed"]) for i, s in enumerate(first)], "name string, pos long, strength int")
    seen = live.select("name", "strength", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    skipped = spark.createDataFrame([], "name string, depth int")
    offer = F.struct((-F.col("strength")).alias("weak"), X.locale_order(F.col("via")).alias("order"), "pos", "via")
    depth, n, places = 0, len(first), max(1, len(first))
    while n:
        depth += 1
        turns = _near(live.select(F.col("name").alias("via"), F.col("pos").alias("turn")), n)
        offers = known.join(turns, "via").select("to_name", "strength", "via", "turn", (F.col("turn") * (2 * wide) + F.col("at")).alias("pos"))
        weak = _near(live.where(F.col("strength") == REASONS["recommended"]).select("name", F.col("pos").alias("own")), n)
        early = (F.col("to_name") == F.col("name")) & (offers["strength"] == REASONS["required"]) & (F.col("turn") < F.col("own"))
        offers = offers.join(weak, early, "left").select("to_name", "strength", "via", "turn", "pos", F.col("own").isNotNull().alias("early"))
        offers, count = _counted(offers, "offers", all=F.count(F.lit(1)), early=F.count_if("early"))
        over = passed_over(offers) if count["early"] else None
        if over is not None:
            skipped = written(skipped.unionByName(over.select(F.col("v").alias("name"), F.lit(depth - 1).alias("depth"))), "skipped")
            offers = offers.join(_near(over.withColumnRenamed("v", "via"), n), "via", "left_anti")
        places *= 2 * wide
        asked = seen
        if count["all"] <= FEW:
            asked = seen.join(F.broadcast(offers.select(F.col("to_name").alias("name"))), "name", "left_semi")
        met = offers.select(F.col("to_name").alias("name"), offer.alias("b"), F.lit(None).cast("int").alias("held"))
        met = met.unionByName(asked.select("name", F.col("strength").alias("held")), allowMissingColumns=True)
        taken = met.groupBy("name").agg(F.min("b").alias("b"), F.max("held").alias("held")).where("b is not null and (held is null or -b.weak > held)")
        opens = F.col("held").isNull()
        if over is not None:
            taken = taken.join(_near(over.select(F.col("v").alias("name"), F.lit(True).alias("passed")), n), "name", "left")
            opens |= F.col("passed").isNotNull()
        taken = taken.select("name", "b.pos", (-F.col("b.weak")).alias("strength"), "b.via", opens.alias("opens"))
        taken, count = _counted(taken, "live", opens=F.count_if("opens"))
        seen = seen.unionByName(taken.select("name", "strength", F.lit(depth).alias("depth"), "via"))
        live, n = taken.where("opens").select("name", "pos", "strength"), count["opens"]
        if places * 2 * wide > most_places:
            live = written(numbered(live, ["pos"], column="place", first=0, name="generation").select("name", F.col("place").alias("pos"), "strength"), "live")
            places = max(1, n)
        if depth % REWRITE == 0:
            seen = written(seen, "labels")
    last = seen.groupBy("name").agg(F.max_by(F.struct("strength", "depth", "via"), "depth").alias("l"))
    entries = last.select("name", reason_of(F.col("l.strength")).alias("reason"), "l.depth", "l.via")
    # all that held a label met their missing relations with it, unless they were passed over
    opened = seen.join(skipped, ["name", "depth"], "left_anti").select(F.col("name").alias("from_name"), "depth")
    gaps = edge_rows.where("to_name is null").join(opened, "from_name").select(F.col("target").alias("name"), reason_of(strength).alias("relation"), F.col("from_name").alias("via"), (F.col("depth") + 1).alias("depth"))
    return entries, gaps.distinct()

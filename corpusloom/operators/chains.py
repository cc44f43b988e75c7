"""Long paths of a graph taken together, so that loops over it take few rounds.

A loop that follows arcs takes as many rounds as the longest path. Most of such a path
is nodes with one way in, or with one way in and one out; pointer jumping joins each of
them with the end of its path in a number of rounds that grows with the logarithm of
the path's length. What is left is a smaller graph, and what was taken out follows from
its result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import shuffled, written


def longest(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """name, level of ``nodes`` (name): the longest path over ``link`` (a, b; distinct,
    without cycles) that ends in each.

    A node with one way in lies just behind the node it comes from, at whatever level
    that is: all of these hang on the first node before them with several ways in or
    none. Arcs between the others get the lengths of the paths they stand for; that is
    repeated while nodes with one way in are left, then levels are passed along the rest."""
    arc = written(link.select("a", "b", F.lit(1).alias("w")), "weighted")
    hung: list[DataFrame] = []
    while True:
        hang = arc.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("w").alias("w")).where("n = 1").select("b", "a", "w")
        hang = written(hang, "hanging")
        if not hang.take(1):
            break
        moved = True
        while moved:
            before = hang.select(F.col("b").alias("a"), F.col("a").alias("top"), F.col("w").alias("more"))
            step = hang.join(shuffled(before), "a", "left").select("b", F.coalesce("top", "a").alias("a"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("top").isNotNull().alias("moved"))
            step = written(step, "hanging")
            hang, moved = step.select("b", "a", "w"), bool(step.where("moved").take(1))
        hung.append(hang)
        ends = hang.select(F.col("b").alias("a"), F.col("a").alias("top"), F.col("w").alias("more"))
        rest = arc.join(shuffled(hang.select("b")), "b", "left_anti").join(shuffled(ends), "a", "left")
        arc = written(rest.select(F.coalesce("top", "a").alias("a"), "b", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w")), "weighted")
    level = nodes.select("name", F.lit(0).alias("level"))
    for h in hung:
        level = level.join(shuffled(h.select(F.col("b").alias("name"))), "name", "left_anti")
    level = written(level, "levels")
    while arc.take(1):
        offer = arc.join(shuffled(level), arc["a"] == level["name"]).groupBy("b").agg(F.max(F.col("level") + F.col("w")).alias("o"))
        step = level.join(shuffled(offer), level["name"] == offer["b"], "left").select("name", F.greatest("level", F.coalesce("o", F.lit(0))).alias("level"), (F.coalesce("o", F.lit(0)) > F.col("level")).alias("moved"))
        step = written(step, "levels")
        level = step.select("name", "level")
        if not step.where("moved").take(1):
            break
    for h in reversed(hung):
        behind = h.join(shuffled(level), h["a"] == level["name"]).select(F.col("b").alias("name"), (F.col("level") + F.col("w")).alias("level"))
        level = written(level.unionByName(behind), "levels")
    return level


def contracted(arc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``arc`` (u, v; distinct, without loops) with each path of nodes that have one way
    in and one way out as a single arc, the nodes of cycles of nothing but these (name,
    root: the cycle's least), and the nodes of paths (name, head, foot: the nodes before
    and behind)."""
    ways = arc.groupBy(F.col("v").alias("name")).agg(F.count("*").alias("n_in")).join(shuffled(arc.groupBy(F.col("u").alias("name")).agg(F.count("*").alias("n_out"), F.min("v").alias("to"))), "name")
    state = written(ways.where("n_in = 1 and n_out = 1").select("name", F.col("name").alias("last"), "to", F.col("name").alias("least")), "chains")
    inner = written(state.select("name"), "inner")
    n = inner.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        further = state.select(F.col("name").alias("to"), F.col("last").alias("l2"), F.col("to").alias("t2"), F.col("least").alias("m2"))
        step = state.join(shuffled(further), "to", "left").select("name", F.coalesce("l2", "last").alias("last"), F.coalesce("t2", "to").alias("to"), F.least("least", F.coalesce("m2", "least")).alias("least"), F.col("t2").isNotNull().alias("moved"))
        step = written(step, "chains")
        state = step.select("name", "last", "to", "least")
        if not step.where("moved").take(1):
            break
    # whoever still points at a node of a chain is on a cycle of them, and has seen all of it
    rings = state.join(shuffled(inner.withColumnRenamed("name", "to")), "to", "left_semi").select("name", F.col("least").alias("root"))
    lines = state.join(shuffled(inner.withColumnRenamed("name", "to")), "to", "left_anti")
    plain = arc.join(shuffled(inner.withColumnRenamed("name", "u")), "u", "left_anti")
    heads = written(plain.join(shuffled(lines.select(F.col("name").alias("v"), "last", "to")), "v").select("u", "last", "to"), "heads")
    paths = written(lines.select("name", "last").join(shuffled(heads), "last").select("name", F.col("u").alias("head"), F.col("to").alias("foot")), "paths")
    kept = plain.join(shuffled(inner.withColumnRenamed("name", "v")), "v", "left_anti").select("u", "v")
    short = heads.where("u <> to").select("u", F.col("to").alias("v"))
    return written(kept.unionByName(short).distinct(), "contracted"), written(rings, "rings"), paths


def ways_of(arc: DataFrame) -> DataFrame:
    """name, n_out, n_in, to, of (the least of each) of the nodes of ``arc`` (u, v)."""
    none = F.lit(None).cast("string")
    ends = arc.select(F.col("u").alias("name"), F.col("v").alias("to"), none.alias("of")).unionByName(arc.select(F.col("v").alias("name"), none.alias("to"), F.col("u").alias("of")))
    return ends.groupBy("name").agg(F.count("to").alias("n_out"), F.count("of").alias("n_in"), F.min("to").alias("to"), F.min("of").alias("of"))


def trimmed(arc: DataFrame, enough: int, least: float = 0.3) -> tuple[DataFrame, int, int]:
    """``arc`` (u, v; distinct, without loops, written) without nodes that have no way in or
    none out, which are on no cycle, how many arcs are left, and how many nodes have at
    most one way in or out. A round drops all such nodes there are; it goes on until
    ``enough`` arcs are left or these nodes are fewer than the part ``least`` of them."""
    while True:
        ways = written(ways_of(arc).select("name", "n_out", "n_in"), "ways")
        one = ways.agg(F.sum("n_out").alias("arcs"), F.count_if(F.least("n_out", "n_in") <= 1).alias("thin"), F.count_if(F.least("n_out", "n_in") == 0).alias("ends")).first()
        n = one["arcs"] or 0
        if n <= enough or one["ends"] < n * least:
            return arc, n, one["thin"]
        live = ways.where("n_out > 0 and n_in > 0").select("name")
        arc = arc.join(shuffled(live.withColumnRenamed("name", "u")), "u", "left_semi").join(shuffled(live.withColumnRenamed("name", "v")), "v", "left_semi")
        arc = written(arc.select("u", "v"), "trimmed")


def thinned(arc: DataFrame, enough: int, least: float = 0.1) -> tuple[DataFrame, list[DataFrame]]:
    """``arc`` (u, v; distinct, without loops, written) without nodes that need no walk: the
    arcs left, and what :func:`thickened` needs to put the nodes back, a table a round.

    A node without ways in or out is on no cycle. One with a single way out is passed by:
    who leads to it leads to the node behind it instead; likewise one with a single way
    in. Neither adds an arc or changes which of the other nodes reach which. A round takes
    those of a half, drawn by hash, whose neighbour on the single way isn't drawn, so no
    two of them hang on each other. It goes on until ``enough`` arcs are left or a round
    takes less than the part ``least`` of them."""
    taken: list[DataFrame] = []
    n = arc.count()
    while n > enough:
        ways = ways_of(arc)
        single = F.least("n_out", "n_in") == 1
        drawn = single & (F.xxhash64("name", F.lit(len(taken))) % 2 == 0)
        some = written(ways.where((F.least("n_out", "n_in") == 0) | drawn).select("name", F.when(F.col("n_out") == 1, F.col("to")).alias("to"), F.when(F.col("n_out") > 1, F.col("of")).alias("of"), (F.least("n_out", "n_in") == 0).alias("gone")), "thin")
        by = F.coalesce("to", "of")
        pairs = some.where("not gone").select("name", by.alias("by"))
        hung = pairs.join(shuffled(pairs.select(F.col("name").alias("by"))), "by", "left_semi").select("name")
        mark = some.join(shuffled(hung), "name", "left_anti")
        one = mark.select(F.col("name").alias("u"), F.col("of").alias("u_of"), F.col("to").alias("u_to"), F.col("gone").alias("u_gone"))
        two = mark.select(F.col("name").alias("v"), F.col("to").alias("v_to"), F.col("of").alias("v_of"), F.col("gone").alias("v_gone"))
        met = arc.join(shuffled(one), "u", "left").join(shuffled(two), "v", "left")
        # the single way itself goes, and what touches a node that is on no cycle
        met = met.where("not coalesce(u_gone, false) and not coalesce(v_gone, false) and u_to is null and v_of is null")
        met = met.select(F.coalesce("u_of", "u").alias("a"), F.coalesce("v_to", "v").alias("b"), F.when(F.col("u_of").isNotNull(), F.col("u")).alias("x"), F.when(F.col("v_to").isNotNull(), F.col("v")).alias("y"))
        met = written(met, "passed-by")
        arc = written(met.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "thinned")
        taken.append(met.where("x is not null or y is not null"))
        was, n = n, arc.count()
        if n > was * (1 - least):
            break
    return arc, taken


def thickened(found: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """name, root of nodes that are in a component with others, given ``found`` (name, root)
    of the arcs that :func:`thinned` left: a node that was passed by is in its neighbour's
    component where one of its other ways leads back there."""
    for met in reversed(taken):
        head, foot = found.select(F.col("name").alias("a"), F.col("root").alias("ra")), found.select(F.col("name").alias("b"), F.col("root").alias("rb"))
        both = met.join(shuffled(head), "a", "left").join(shuffled(foot), "b", "left").where("coalesce(ra, a) = coalesce(rb, b)")
        more = both.select(F.explode(F.array("x", "y")).alias("name"), F.coalesce("ra", "a").alias("root")).where("name is not null")
        # the neighbour may have stood for itself until now
        own = both.select(F.col("a").alias("name"), F.coalesce("ra", "a").alias("root"))
        found = written(found.unionByName(more).unionByName(own).distinct(), "thickened")
    return found

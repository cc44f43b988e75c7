"""Connected components by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written


def _sum(edges: DataFrame) -> tuple:
    """What tells one set of links from another; nothing in it overflows, however many there are."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()[:]


def connected_components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``links`` has columns u, v (long). Returns node, root for every node of a
    link; the root is the component's least node.

    Each round joins every node with the least of its neighbours (aggregated
    before the shuffle, so a hub is one row a task) and is written to the shared
    folder; rounds grow with the logarithm of the component's size. If ``most_rounds``
    end before nothing changes any more, that is an error, not a result.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _sum(edges)
    for left in range(most_rounds, -1, -1):
        if not state[0]:
            break
        if not left:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if (now := _sum(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

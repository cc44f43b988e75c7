"""Prefix trie of conversations, with totals of all subtrees by pointer jumping.

A node is a distinct sequence of first turns. It is keyed by a digest of 128 bits: the
exclusive or of a hash of each turn together with its place, so that the digest of all
prefixes is a running aggregate and the parent's digest is the node's without its last
turn; no walk along a conversation is needed. Prefixes that conversations share are
counted before the shuffle.

Totals of subtrees take logarithmic rounds: after round k every node knows the sum over
its descendants fewer than 2^k levels below it and its ancestor 2^k levels above. The
next round adds what its descendants exactly 2^k levels below know (summed by that
ancestor before the shuffle) and takes the ancestor's ancestor. A trie of depth d takes
log2(d) rounds, each written to the shared folder.

No text is shuffled, only hashes and byte counts. Turns get their places by ranges of
(conversation, turn) and running digests come in two levels, so a conversation may have
any share of all turns. Ids of conversations that end at a node are joined in pieces of
``PIECE`` consecutive ids; up to ``PIECES`` pieces are hashed by one expression, more
as a stream of pieces in order, of which one batch is in memory.

Defined results: a null role or text is empty; turns with the same number (null: before
all others) stand in the order of their hashes, repeated rows included. Rows with a null
conversation id belong to no conversation. Without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.operators.ranks import numbered

#: Consecutive ids in a piece, and pieces that one expression joins.
PIECE, PIECES = 4096, 64
#: Turns of a conversation over which a digest runs in one window.
CHUNK = 1024
#: Turns that are borrowed at most, and conversations that share a lender.
MOST_BORROWED, FAMILY = 8, 5


def _mix(seed: str, *of: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 0), x, y (128 bits of role and text), bytes (of the text): a
    written table."""
    empty = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    said = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), _mix("x", empty(role), empty(text)).alias("x"), _mix("y", empty(role), empty(text)).alias("y"), F.octet_length(empty(text)).cast("long").alias("bytes")
    )
    return written(numbered(said, ["turn", "x", "y"], ["c"], "pos", first=0, name="turns").drop("turn"), "turns")


def rebuilt(said: DataFrame, most: int = MOST_BORROWED, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations with a borrowed beginning: the first h turns of the family's first
    conversation and then their own after as many; h is crc32 of the id modulo
    ``most`` + 1. Returns c, pos, x, y, bytes and all conversations (c, n: turns)."""
    convs = said.groupBy("c").agg(F.count("*").alias("n_own"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    convs = convs.select("c", "n_own", h.alias("h"), (F.col("c") - F.col("c") % family).alias("lender"))
    heads = said.where(F.col("pos") < most).withColumnRenamed("c", "lender")
    lenders = heads.groupBy("lender").agg(F.count("*").alias("n_head"))
    convs = convs.join(lenders, "lender", "left").withColumn("n_lent", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = written(convs.select("c", "h", "lender", "n_lent", (F.col("n_lent") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n")), "conversations")
    lent = convs.where("n_lent > 0").join(heads, "lender").where("pos < h").select("c", "pos", "x", "y", "bytes")
    own = said.join(convs, "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("n_lent")).alias("pos"), "x", "y", "bytes")
    return lent.unionByName(own), convs.select("c", "n")


def prefixes(said: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """c, depth, bytes, a, b (digest of the prefix), pa, pb (of the one before) for
    each turn of ``said`` (c, pos, x, y, bytes)."""
    keyed = said.select("c", "pos", "bytes", F.expr(f"pos div {chunk}").alias("part"), _mix("a", "pos", "x", "y").alias("ta"), _mix("b", "pos", "y", "x").alias("tb"))
    keyed = written(keyed, "turn-digests")
    within = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = keyed.withColumn("a", F.bit_xor("ta").over(within)).withColumn("b", F.bit_xor("tb").over(within))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each chunk of a conversation that has several
    parts = keyed.groupBy("c", "part").agg(F.bit_xor("ta").alias("ca"), F.bit_xor("tb").alias("cb"))
    several = parts.join(parts.where("part > 0").select("c").distinct(), "c", "left_semi")
    carried = several.select("c", "part", F.bit_xor("ca").over(earlier).alias("ca"), F.bit_xor("cb").over(earlier).alias("cb")).where("part > 0")
    found = runs.join(carried, ["c", "part"], "left")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in ("a", "b")}
    return found.select("c", (F.col("pos") + 1).alias("depth"), "bytes", *[v.alias(k) for k, v in whole.items()], *[v.bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k, v in whole.items()])


def nodes(pre: DataFrame, convs: DataFrame) -> DataFrame:
    """a, b (digest), pa, pb (parent's; null for the root), depth, conv (smallest
    member), n_convs, bytes (of the last text). The root's digest is 0, 0."""
    inner = pre.groupBy("a", "b", "depth").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return inner.unionByName(root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), none.alias("pa"), none.alias("pb"), "conv", "n_convs", zero.alias("bytes")))


def subtree_sums(tree: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``tree`` (a, b, pa, pb, depth and ``columns``) with each of ``columns`` summed
    over the node and all its descendants."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    state = tree.select("a", "b", "depth", F.col("pa").alias("ja"), F.col("pb").alias("jb"), *columns)
    step = 1
    while step <= deepest:
        # who stands `step` levels above: there from this depth on
        up = state.where(F.col("depth") >= step).groupBy("ja", "jb").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
        more = state.join(up.toDF("a", "b", *[f"s_{c}" for c in columns]), ["a", "b"], "left")
        sums = [(F.col(c) + F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in columns]
        # who has nobody twice as far above looks up itself, so the root is no key that most would meet
        beyond = F.col("depth") >= 2 * step
        more = more.select("a", "b", "depth", F.when(beyond, F.col("ja")).otherwise(F.col("a")).alias("ka"), F.when(beyond, F.col("jb")).otherwise(F.col("b")).alias("kb"), *sums)
        if 2 * step <= deepest:
            more = more.join(state.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "ja", "jb"), ["ka", "kb"])
        else:
            more = more.withColumns({"ja": F.col("ka"), "jb": F.col("kb")})
        jumps = [F.when(beyond, F.col(j)).alias(j) for j in ("ja", "jb")]
        state = written(more.select("a", "b", "depth", *jumps, *columns), "rollup")
        step *= 2
    return state.select("a", "b", *columns)


def _streamed(key: tuple[Any, ...], pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of one node's pieces, which come in ascending order."""
    sha, last = hashlib.sha256(), None
    for batch in pieces:
        for part, text in zip(batch["part"], batch["ids"], strict=True):
            if last is not None:
                if part <= last:
                    raise ValueError("pieces of ids out of order")
                sha.update(b",")
            sha.update(text.encode())
            last = part
    yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "ends": [sha.hexdigest()]})


def ends(pre: DataFrame, convs: DataFrame, piece: int = PIECE, pieces: int = PIECES) -> DataFrame:
    """a, b, ends: SHA-256 of the ascending ids of the conversations that end at a
    node, joined by commas; nodes where none ends are left out."""
    last = pre.join(convs, "c").where("depth = n").select("a", "b", "c")
    zero = F.lit(0).cast("long")
    last = last.unionByName(convs.where("n = 0").select(zero.alias("a"), zero.alias("b"), "c"))
    # by ranges of ids: ascending pieces, none of more than so many ids
    parts = last.groupBy("a", "b", F.expr(f"(c - pmod(c, {piece})) div {piece}").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = written(parts, "ends")
    counts = parts.groupBy("a", "b").agg(F.count("*").alias("n"))
    many = written(counts.where(F.col("n") > pieces).select("a", "b"), "hot-ends")
    few = parts.join(many, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("x"))
    few = few.select("a", "b", F.sha2(F.array_join("x.ids", ",").cast("binary"), 256).alias("ends"))
    if not many.take(1):
        return few
    # the groups take partitions and order as they are, so pieces arrive in order
    ordered = parts.join(many, ["a", "b"]).repartition("a", "b").sortWithinPartitions("a", "b", "part")
    return few.unionByName(ordered.groupBy("a", "b").applyInPandas(_streamed, "a long, b long, ends string"))


def report(rows: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations, see the contract."""
    said, convs = rebuilt(turns(rows))
    pre = written(prefixes(said), "prefixes")
    tree = written(nodes(pre, convs), "nodes")
    kids = tree.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children")).toDF("a", "b", "n_children")
    tree = tree.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = written(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    sums = subtree_sums(tree, ("n_leaves", "saved_tokens"))
    parents = tree.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    found = tree.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"]).join(ends(pre, convs), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))


REPORT_SQL = """
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) AS r(i)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 5 AS lender, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t), crc),
lent AS (SELECT v.c, pos, role, text FROM v JOIN t ON t.c = lender AND pos < h),
n AS (SELECT c, count(*) AS n FROM lent GROUP BY c),
r AS (SELECT * FROM lent UNION ALL SELECT c, pos - h + coalesce(n, 0), role, text FROM t JOIN v USING (c) LEFT JOIN n USING (c) WHERE pos >= h),
k AS (SELECT c, pos + 1 AS depth, text, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY pos)) AS key FROM r),
p AS (SELECT *, lag(key, 1, '') OVER (PARTITION BY c ORDER BY depth) AS up, lead(key) OVER (PARTITION BY c ORDER BY depth) IS NULL AS last FROM k
      UNION ALL SELECT c, 0, '', '', NULL, c NOT IN (SELECT c FROM r) FROM v),
g AS (SELECT key, depth, min(up) AS up, min(c) AS conv, count(*) AS n_convs, max(octet_length(encode(text))) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends FROM p GROUP BY key, depth),
f AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN f USING (key)),
s AS (SELECT p.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM w JOIN p ON p.c = w.conv AND p.depth <= w.depth GROUP BY p.key)
SELECT w.conv AS conv_id, w.depth, o.conv AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (key) LEFT JOIN w AS o ON o.key = w.up
"""

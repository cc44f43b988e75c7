"""URL filters by a temporal join with dated block and allow lists.

List entries are dated changes (add or remove a host or a URL prefix). For each
list and key the changes become validity intervals: an entry holds from its day to
the next change of that key in the same list; lists don't end each other's entries. A capture's URL yields its keys (every suffix of its host and
every path prefix); an equi-join on the key with the interval that holds at fetch
time evaluates it as of then. Of the entries found, an allow entry wins over block
entries of keys that are no more specific.

Most keys of captures are on no list, among them those that most captures share
(``d:com``). A list of more than ``FEW_KEYS`` intervals is too large to be sent to all
tasks, so its keys' bits are: a bitmap of 16 bits a key, in pieces, of at most
``MOST_BITS`` bits. Keys whose bit isn't set drop out before the join; what is left
are listed keys and about one in sixteen others. A listed key that most captures share
is one key of a join whose large side Spark splits.

Defined results: null URLs, URLs without a host and null fetch times match nothing
and are allowed; of an addition and a removal of one key by one list at one time the
removal holds; entries without a key, time or known action are ignored, those of a
null list form a list of their own; where lists agree on a key the name that sorts
last is shown; captures at the very time of a change see the change; equal captures
are evaluated each; further columns are carried by name, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import plainly_named, written

#: Intervals up to which the join alone decides; bits of the bitmap at most (16 MB), bits of a piece.
FEW_KEYS, MOST_BITS, PIECE = 100_000, 1 << 27, 1 << 15
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without its last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def keys_of(url: Column) -> Column:
    """Keys of a URL: ``d:`` and each suffix of its host, ``p:`` host and each prefix
    of its path that ends before a slash or at its end."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.split(F.regexp_replace(path_of(url), r"^/+|/+$", ""), "/+")
    k = F.size(steps)
    paths = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host != "", F.concat(domains, F.filter(paths, lambda p: ~p.endswith("/")))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list, action add|remove, verdict block|allow, key, day) to intervals
    key, verdict, list, since, until (exclusive, null: still holds)."""
    usable = entries.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove") & F.col("verdict").isin("block", "allow"))
    same_time = Window.partitionBy("list", "verdict", "key", "at").orderBy(F.desc("action"))
    last = usable.withColumn("r", F.row_number().over(same_time)).where("r = 1")
    following = Window.partitionBy("list", "verdict", "key").orderBy("at")
    return last.withColumn("until", F.lead("at").over(following)).where("action = 'add'").select("key", "verdict", "list", F.col("at").alias("since"), "until")


def maybe_listed(keyed: DataFrame, valid: DataFrame, few_keys: int = FEW_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """``keyed`` without keys that surely aren't in ``valid``."""
    n = valid.count()
    if n <= few_keys:
        return keyed
    bits = min(max(PIECE, 1 << (16 * n).bit_length()), most_bits)
    bit = F.pmod(F.xxhash64("key"), F.lit(bits))
    marks = valid.select(bit.alias("bit")).groupBy(F.expr(f"bit div {PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % PIECE).alias("marks"))
    # most_bits bounds what is sent: 4 KB a piece
    found = keyed.withColumn("bit", bit).join(F.broadcast(marks), F.expr(f"bit div {PIECE}") == F.col("piece"))
    byte = F.conv(F.hex(F.expr(f"substring(marks, cast((bit % {PIECE}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(keyed.columns)


def evaluate(captures: DataFrame, entries: DataFrame, keep: tuple[str, ...], url: str = "url", fetched: str = "fetched_at", few_keys: int = FEW_KEYS) -> DataFrame:
    """``keep`` columns with blocked, n_active (entries in force), decided_by (key of
    the deciding entry) and list (its list) for every capture."""
    valid = written(intervals(entries), "intervals")
    plain, names = plainly_named(captures)
    named = [F.col(names[c]).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = plain.select(*named, F.col(names[fetched]).alias("at"), keys_of(F.col(names[url])).alias("keys"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "captures")
    keyed = rows.select("row", "at", F.explode("keys").alias("key"))
    held = maybe_listed(keyed, valid, few_keys).join(valid, "key").where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    # the longest key decides; at one length a path beats a domain, an allow entry a block entry
    order = F.struct(F.char_length("key").alias("n"), F.col("key").alias("k"), (F.col("verdict") == "allow").alias("a"), F.col("list").alias("l"))
    found = held.groupBy("row").agg(F.count("*").alias("n_active"), F.max_by(F.struct("verdict", "key", "list"), order).alias("d"))
    out = rows.join(found, "row", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce(F.col("d.verdict") == "block", F.lit(False)).alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("d.key").alias("decided_by"), F.col("d.list").alias("list"))

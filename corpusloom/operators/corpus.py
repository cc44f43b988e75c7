"""A corpus: documents after canonical dedupe, aliases, scopes, and its log of conflicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.ranks import numbered
from corpusloom.operators.tables import written

TEXTS = T.ArrayType(T.StringType())
DOCUMENT = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("skill_id", T.StringType()),
        T.StructField("canonical_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_root", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("keywords", TEXTS),
        T.StructField("tags", TEXTS),
        T.StructField("aliases", TEXTS),
        T.StructField("requires", TEXTS),
        T.StructField("recommends", TEXTS),
        T.StructField("body_text", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("mtime_ms", T.DoubleType()),
    ]
)


#: Rows of one name or alias that are looked at in one window.
HOT = 10_000


def classify_scopes(documents: DataFrame, roots: DataFrame, path: str = "path", fallback: str | None = None) -> DataFrame:
    """Adds ``scope``: the longest root (scope, root, rank) that is the path or a
    ``/``-bounded prefix of it, ties by rank; else ``fallback``.

    The prefixes of a path are exploded and equi-joined with the roots, so no pair
    of all paths and roots is formed.
    """
    known = roots.select("scope", F.regexp_replace("root", "/+$", "").alias("root"), "rank")
    best = known.groupBy("root").agg(F.min_by("scope", "rank").alias("scope"))
    paths = documents.select(F.col(path).alias("__p")).distinct()
    found = paths.select("__p", F.explode(_prefixes_of(F.col("__p"))).alias("root")).join(best, "root").groupBy("__p").agg(F.max_by("scope", F.char_length("root")).alias("__scope"))
    joined = documents.drop("scope").join(found, documents[path] == F.col("__p"), "left")
    return joined.withColumn("scope", F.coalesce("__scope", F.lit(fallback))).drop("__p", "__scope")


def _prefixes_of(path: Column) -> Column:
    steps = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def preference(priority: list[str]) -> list[Column]:
    """Order in which documents of one name are preferred: scope priority (unlisted
    scopes last and alike), newest, smaller path."""
    rank = F.coalesce(*[F.when(F.col("scope") == s, F.lit(i)) for i, s in enumerate(priority)], F.lit(len(priority))) if priority else F.lit(0)
    return [rank, F.col("mtime_ms").desc(), F.col("path")]


def scope_of(path: Column, roots: dict[str, list[str]], fallback: str | None = None) -> Column:
    """:func:`classify_scopes` for the roots of settings, as an expression: nothing is
    joined, so no body is shuffled."""
    owner: dict[str, str] = {}
    for scope, some in roots.items():
        for root in some:
            owner.setdefault(root.rstrip("/"), scope)
    # the longest root that fits comes first; compared as a whole, so no path is cut into its prefixes
    found = [F.when((path == root) | path.startswith(f"{root}/"), F.lit(owner[root])) for root in sorted(owner, key=len, reverse=True)]
    return F.coalesce(*found, F.lit(fallback))


def least_so_far(rows: DataFrame, by: str, order: list[str], value: str, most: int = HOT) -> DataFrame:
    """``rows`` with ``was``: the least ``value`` of the rows before, in ``order``, that
    share ``by``; null for the first.

    Groups of more than ``most`` rows are cut into runs of as many: minima within a run,
    and of the runs before it, so that a group of any size spreads over tasks."""
    before = lambda w: F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hot = written(rows.groupBy(by).count().where(F.col("count") > most).select(by), "hot-names")
    if not hot.take(1):
        return rows.withColumn("was", before(Window.partitionBy(by).orderBy(*order)))
    small = rows.join(hot, by, "left_anti").select(rows.columns).withColumn("was", before(Window.partitionBy(by).orderBy(*order)))
    placed = numbered(rows.join(hot, by, "left_semi").select(rows.columns), order, [by], "__at", first=0, name="runs").withColumn("__run", F.expr(f"__at div {most}"))
    placed = written(placed, "runs")
    runs = placed.groupBy(by, "__run").agg(F.min(value).alias("__least"))
    runs = runs.select(by, "__run", F.min("__least").over(Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = placed.withColumn("__in", before(Window.partitionBy(by, "__run").orderBy("__at"))).join(runs, [by, "__run"])
    return small.unionByName(within.select(*rows.columns, F.least("__in", "__before").alias("was")))


def winning(documents: DataFrame, priority: list[str]) -> tuple[DataFrame, DataFrame]:
    """Winners of each canonical name, and the rows (canonical_name, path, ordinal, k: the
    order of preference) of names that several documents have.

    A winner's ordinal is the first at which its name was seen. All is decided on names,
    paths and times of names that several documents have; documents with their bodies
    then meet these marks once (by broadcast where they are few)."""
    rank, _, _ = preference(priority)
    key = F.struct(rank.alias("a"), (-F.col("mtime_ms")).alias("b"), F.col("path").alias("c"), F.col("ordinal").alias("d"))
    thin = documents.select("canonical_name", "path", "ordinal", key.alias("k"))
    # numbers alone, so that all names are counted by hash; keys, which would be sorted, are compared among the few
    crowded = written(thin.groupBy("canonical_name").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).where("n > 1"), "crowded-names")
    if not crowded.where("canonical_name is not null").take(1):
        return documents, thin.limit(0)
    some = written(thin.join(crowded, "canonical_name"), "collisions")
    best = some.groupBy("canonical_name").agg(F.min("k").alias("best"))
    marks = some.join(best, "canonical_name").groupBy("canonical_name", "path", "ordinal").agg(F.max(F.col("k") == F.col("best")).alias("__keep"), F.max("first").alias("__first"), F.count("*").alias("__n"))
    marks = written(marks, "marks")
    same = documents["canonical_name"].eqNullSafe(marks["canonical_name"]) & documents["path"].eqNullSafe(marks["path"]) & documents["ordinal"].eqNullSafe(marks["ordinal"])
    winners = documents.join(marks, same, "left").where("coalesce(__keep, true)")
    winners = winners.select(*[F.coalesce("__first", documents[c]).alias(c) if c == "ordinal" else documents[c] for c in documents.columns])
    if marks.where("__keep and __n > 1").take(1):
        # the same document several times: nothing tells the rows apart
        winners = winners.dropDuplicates(["canonical_name"])
    return winners, some


def dedupe(documents: DataFrame, priority: list[str], most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Winners of each canonical name, see :func:`winning`, and the log of collisions
    (canonical_name, kept_path, dropped_path): one row for each further document of a name
    in traversal order, against the winner so far."""
    winners, some = winning(documents, priority)
    log = least_so_far(some.select("canonical_name", "path", "ordinal", "k"), "canonical_name", ["ordinal", "path"], "k", most).where("was is not null")
    wins = F.col("k") < F.col("was")
    log = log.select("canonical_name", F.when(wins, F.col("path")).otherwise(F.col("was.c")).alias("kept_path"), F.when(wins, F.col("was.c")).otherwise(F.col("path")).alias("dropped_path"))
    return winners, log


def owners(documents: DataFrame, priority: list[str]) -> DataFrame:
    """alias, canonical_name, k (the order of preference), at, n (the place) of all names and aliases."""
    rank, _, _ = preference(priority)
    key = F.struct(rank.alias("a"), (-F.col("mtime_ms")).alias("b"), F.col("path").alias("c"), F.col("canonical_name").alias("d"))
    own = documents.select(F.col("canonical_name").alias("alias"), "canonical_name", key.alias("k"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("n"))
    more = documents.select(F.posexplode("aliases").alias("n", "alias"), "canonical_name", key.alias("k"), F.col("ordinal").alias("at")).select("alias", "canonical_name", "k", "at", "n")
    return own.unionByName(more)


def preferred(rows: DataFrame) -> DataFrame:
    """alias, canonical_name of the preferred of each alias' :func:`owners`."""
    return rows.groupBy("alias").agg(F.min("k").alias("k")).select("alias", F.col("k.d").alias("canonical_name"))


def alias_map(documents: DataFrame, priority: list[str], most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """alias -> canonical_name over names and aliases, each owned by the preferred
    document; and the conflicts (alias, canonical_name, conflicting_canonical_name)
    of every further owner against the preferred one so far."""
    rows = written(owners(documents, priority), "owners")
    owner = preferred(rows)
    log = least_so_far(rows, "alias", ["at", "n", "canonical_name"], "k", most).where("was is not null and was.d <> canonical_name")
    wins = F.col("k") < F.col("was")
    log = log.select("alias", F.when(wins, F.col("canonical_name")).otherwise(F.col("was.d")).alias("canonical_name"), F.when(wins, F.col("was.d")).otherwise(F.col("canonical_name")).alias("conflicting_canonical_name"))
    return owner, log.distinct()


@dataclass
class Settings:
    """What a corpus is built and searched with."""

    scope_priority: list[str] = field(default_factory=list)
    scope_roots: dict[str, list[str]] = field(default_factory=dict)
    preset_names: list[str] = field(default_factory=list)
    max_top_k: int = 50
    preview_chars: int = 250
    cache_ttl_ms: int = 60_000


@dataclass
class Corpus:
    """Documents with what is derived from them. Frames are lazy; ``malformed`` is
    (path, reason)."""

    documents: DataFrame
    aliases: DataFrame
    duplicates: DataFrame
    alias_conflicts: DataFrame
    malformed: DataFrame
    settings: Settings

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def materialised(self) -> Corpus:
        """The corpus with its frames written to the shared folder, once for many requests."""
        frames = {n: written(getattr(self, n), n.replace("_", "-")) for n in ("documents", "aliases", "duplicates", "alias_conflicts")}
        return Corpus(**frames, malformed=self.malformed, settings=self.settings)

    def restricted(self, names: list[str]) -> Corpus:
        """The corpus of the named documents only."""
        wanted = self.documents.where(F.col("canonical_name").isin(names) | F.arrays_overlap("aliases", F.array(*[F.lit(n) for n in names]))) if names else self.documents
        return Corpus(wanted, alias_map(wanted, self.settings.scope_priority)[0], self.duplicates, self.alias_conflicts, self.malformed, self.settings)


def scope_table(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    rows = [(s, r, i) for i, (s, r) in enumerate((s, r) for s, rs in roots.items() for r in rs)]
    return spark.createDataFrame(rows, "scope string, root string, rank int")


def scoped(documents: DataFrame, settings: Settings) -> DataFrame:
    return documents.withColumn("scope", scope_of(F.col("path"), settings.scope_roots, "unclassified")) if settings.scope_roots else documents


def build(documents: DataFrame, settings: Settings, malformed: DataFrame | None = None) -> Corpus:
    """A corpus of parsed documents: scopes classified, names deduped, aliases owned."""
    spark = documents.sparkSession
    documents = scoped(documents, settings)
    winners, log = dedupe(documents, settings.scope_priority)
    owner, conflicts = alias_map(winners, settings.scope_priority)
    if malformed is None:
        malformed = spark.createDataFrame([], "path string, reason string")
    return Corpus(winners, owner, log, conflicts, malformed, settings)

"""Decisions over candidates: decide, plan, route, compare, recommend, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import search as S
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.index import Index
from corpusloom.operators.ranks import numbered
from corpusloom.operators.tables import written

#: Decisions of more candidates are numbered by ranges instead of as the end of a top-k.
TOP = 10_000
SHOWN = ("path", "title", "category", "scope", "aliases")


def basis(query: str | None, names: list[str]) -> str:
    return "query+names" if query and names else "names" if names else "query"


def candidates(corpus: Corpus, index: Index, query: str | None, names: list[str], limit: int, min_score: float = 0.0) -> DataFrame:
    """Named documents in request order, then hits; each once: pos, name, explicit,
    query_score, query_coverage, matched_terms and the document's columns."""
    d = corpus.documents
    first = S.named(corpus, names).where("canonical_name is not null").select("canonical_name", F.col("pos").cast("long").alias("pos"), F.lit(True).alias("explicit"))
    none = d.sparkSession.createDataFrame([], "canonical_name string, at long, query_score double, query_coverage int, matched_terms array<string>")
    hits = S.ranked(corpus, index, query, limit, min_score).select("canonical_name", (F.col("rank") + (1 << 32)).alias("at"), F.col("score").alias("query_score"), F.col("coverage").alias("query_coverage"), "matched_terms") if query else none
    both = first.join(hits, "canonical_name", "full_outer")
    both = both.select("canonical_name", F.coalesce("pos", "at").alias("pos"), F.coalesce("explicit", F.lit(False)).alias("explicit"), "query_score", "query_coverage", F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"))
    # written, so that a request's few are broadcast and no body is shuffled to meet them
    return written(both, "chosen").join(d, "canonical_name").withColumnRenamed("canonical_name", "name")


def _sorted_names(names: str) -> Column:
    return F.array_sort(F.collect_set(names))


def decide(corpus: Corpus, pool: DataFrame, limit: int, top: int = TOP) -> DataFrame:
    """Candidates by weight: rank, name, score, query_score, query_coverage, explicit,
    peer_required_by, peer_recommended_by, required_peers, unresolved_requires,
    reasons, preview. The first is the winner."""
    pool = written(pool, "pool")
    own = corpus.aliases.select(F.col("alias").alias("target"), F.col("canonical_name").alias("c"))
    rows = [pool.select("name", F.explode(c).alias("target"), F.lit(c).alias("relation")) for c in ("requires", "recommends")]
    links = rows[0].unionByName(rows[1]).join(own, "target", "left").select("name", "relation", "target", F.coalesce("c", "target").alias("to"))
    inner = links.join(pool.select(F.col("name").alias("to")), "to", "left_semi").where("name <> to")
    into = inner.groupBy(F.col("to").alias("name")).agg(F.array_sort(F.collect_set(F.when(F.col("relation") == "requires", F.col("name")))).alias("peer_required_by"), F.array_sort(F.collect_set(F.when(F.col("relation") == "recommends", F.col("name")))).alias("peer_recommended_by"))
    out = inner.where("relation = 'requires'").groupBy("name").agg(_sorted_names("to").alias("required_peers"))
    broken = links.where("relation = 'requires'").join(corpus.documents.select(F.col("canonical_name").alias("to")), "to", "left_anti").groupBy("name").agg(_sorted_names("target").alias("unresolved_requires"))
    none = F.array().cast("array<string>")
    found = pool.join(into, "name", "left").join(out, "name", "left").join(broken, "name", "left")
    lists = ("peer_required_by", "peer_recommended_by", "required_peers", "unresolved_requires")
    found = found.withColumns({c: F.coalesce(c, none) for c in lists})
    n = {c: F.size(c) for c in lists}
    raw = F.coalesce("query_score", F.lit(0.0)) + F.coalesce("query_coverage", F.lit(0)) * 0.25 + F.when(F.col("explicit"), 0.5).otherwise(0.0) + n["peer_required_by"] * 4 + n["peer_recommended_by"] * 2 - n["required_peers"] * 2 - n["unresolved_requires"] * 4
    found = found.withColumn("score", X.fixed3_column(raw)).withColumn("query_score", X.fixed3_column(F.col("query_score")))
    joined = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    reasons = F.array(
        F.when(F.col("query_score").isNotNull(), F.format_string("query score %.3f coverage %d", "query_score", F.coalesce("query_coverage", F.lit(0)))),
        F.when(F.col("explicit"), F.lit("explicit names input")),
        joined("required by peers: ", "peer_required_by"),
        joined("recommended by peers: ", "peer_recommended_by"),
        joined("requires peers first: ", "required_peers"),
        joined("unresolved requires: ", "unresolved_requires"),
    )
    order = [F.col("score").desc(), F.coalesce("query_score", F.lit(0.0)).desc(), F.size("peer_required_by").desc(), X.locale_order(F.col("name"))]
    ranked = found.orderBy(*order).limit(limit) if limit <= top else numbered(found, order, column="rank", name="decision").where(F.col("rank") <= limit)
    few = ranked.select("name", X.read_path(F.col("name")).alias("read_path"), *SHOWN, "score", "query_score", "query_coverage", "explicit", *lists, F.array_compact(reasons).alias("reasons"), X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("preview"), *([] if limit <= top else [F.col("rank").cast("int").alias("rank")]))
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if limit <= top else few


def decide_width(corpus: Corpus, n_docs: int, limit: int) -> int:
    """How many candidates a plan of ``limit`` steps looks at."""
    return max(1, n_docs if limit >= corpus.settings.max_top_k else min(max(limit * 5, 25), n_docs))


def plan(decision: DataFrame, full: bool, limit: int) -> tuple[str | None, DataFrame, DataFrame]:
    """The winner, steps (order, phase, reason, via and the candidate's columns), and
    deferred names: winner, peers that require it, peers that recommend it (full mode
    only), then alternatives; cut to ``limit``."""
    decision = written(decision, "decision")
    head = decision.where("rank = 1").select("name").first()
    winner = head["name"] if head else None
    first = decision.where("rank = 1")
    tiers = first.select(F.col("name"), F.lit(0).alias("tier"))
    tiers = tiers.unionByName(first.select(F.explode("peer_required_by").alias("name"), F.lit(1).alias("tier")))
    if full:
        tiers = tiers.unionByName(first.select(F.explode("peer_recommended_by").alias("name"), F.lit(2).alias("tier")))
    tiers = tiers.groupBy("name").agg(F.min("tier").alias("tier"))
    rows = decision.join(tiers, "name", "left").withColumn("tier", F.coalesce("tier", F.lit(3)))
    cut = rows.orderBy("tier", "rank").limit(limit).withColumn("order", F.row_number().over(Window.orderBy("tier", "rank")))
    label = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("tier") + 1)
    steps = cut.withColumns({"phase": label("first", "next", "later", "later"), "reason": label("winner", "unblocks-required-peer", "unblocks-recommended-peer", "alternative"), "via": F.when(F.col("tier").isin(1, 2), F.lit(winner))})
    steps = steps.select("order", "phase", "reason", "via", "name", "read_path", "path", "title", "category", "scope", "score", "query_score", "preview", "tier")
    deferred = decision.join(steps.select("name"), "name", "left_anti").select("rank", "name")
    return winner, steps, deferred


def route(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """Phases: consecutive steps of one kind and layer (order, kind, layer, names,
    read_paths, rationale). ``entries`` are a projection's, with layers."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("start", "read-layer", "apply-layer", "fallback")]), F.col("tier") + 1)
    rows = steps.join(entries.select("name", "read_layer", "apply_layer"), "name", "left").withColumn("kind", kind)
    layer = F.when(F.col("kind") == "read-layer", F.col("read_layer")).when(F.col("kind") == "apply-layer", F.coalesce("apply_layer", "read_layer"))
    rows = rows.withColumn("layer", layer)
    line = Window.orderBy("order")
    fresh = ~(F.col("kind").eqNullSafe(F.lag("kind").over(line)) & F.col("layer").eqNullSafe(F.lag("layer").over(line)))
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(line))
    shown = F.coalesce(F.col("layer").cast("string"), F.lit("-"))
    why = F.when(F.col("kind") == "start", "decide winner").when(F.col("kind") == "read-layer", F.concat(F.lit("pack read layer "), shown)).when(F.col("kind") == "apply-layer", F.concat(F.lit("pack apply layer "), shown)).otherwise("remaining planned steps")
    gathered = rows.groupBy(F.col("island").alias("order"), "kind", "layer").agg(F.array_sort(F.collect_list(F.struct("order", "name", "read_path"))).alias("s"), F.min(why).alias("why"))
    return gathered.select(F.col("order").cast("int").alias("order"), "kind", "layer", F.transform("s", lambda x: x["name"]).alias("names"), F.transform("s", lambda x: x["read_path"]).alias("read_paths"), F.array("why").alias("rationale"))


def compare(pool: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Entries and unordered pairs of the first 2 to 8 candidates: at most 28 pairs."""
    few = pool.orderBy("pos").limit(max(2, min(limit, 8)))
    few = written(few, "compared")
    side = lambda p: few.select(*[F.col(c).alias(f"{p}_{c}") for c in ("pos", "name", "category", "aliases", "matched_terms", "requires", "recommends", "query_score")])
    pairs = side("l").join(F.broadcast(side("r")), F.col("l_pos") < F.col("r_pos"))
    both = lambda c: F.array_sort(F.array_distinct(F.array_intersect(f"l_{c}", f"r_{c}")))
    only = lambda a, b, c: F.array_sort(F.array_except(f"{a}_{c}", f"{b}_{c}"))

    def relation(a: str, b: str) -> Column:
        target = F.concat(F.array(f"{b}_name"), f"{b}_aliases")
        return F.when(F.arrays_overlap(f"{a}_requires", target), "requires").when(F.arrays_overlap(f"{a}_recommends", target), "recommends")

    delta = F.when(F.col("l_query_score").isNotNull() | F.col("r_query_score").isNotNull(), F.coalesce("l_query_score", F.lit(0.0)) - F.coalesce("r_query_score", F.lit(0.0)))
    pairs = pairs.select(
        F.col("l_name").alias("left_name"), F.col("r_name").alias("right_name"), F.col("l_category").eqNullSafe(F.col("r_category")).alias("same_category"),
        both("aliases").alias("shared_aliases"), both("matched_terms").alias("shared_matched_terms"), only("l", "r", "matched_terms").alias("left_only_matched_terms"), only("r", "l", "matched_terms").alias("right_only_matched_terms"),
        both("requires").alias("shared_requires"), both("recommends").alias("shared_recommends"), relation("l", "r").alias("left_to_right"), relation("r", "l").alias("right_to_left"), X.fixed3_column(delta).alias("score_delta"),
    )
    return few, pairs


def recommend(corpus: Corpus, index: Index, edge_rows: DataFrame, seed_names: list[str], query: str | None, full: bool, limit: int, min_score: float = 0.0) -> DataFrame:
    """What to read after the seeds: hits, neighbours by relation, and documents of a
    seed's category, their signals added up."""
    spark, d = corpus.spark, corpus.documents
    few = F.broadcast(spark.createDataFrame([(s,) for s in seed_names], "seed string"))
    used = edge_rows.where("to_name is not null") if full else edge_rows.where("to_name is not null and relation = 'requires'")
    relation = F.when(F.col("relation") == "requires", "required").otherwise("recommended")
    out = used.join(few, F.col("from_name") == F.col("seed")).select(F.col("to_name").alias("name"), F.lit("out").alias("kind"), F.col("seed").alias("via"), relation.alias("relation"))
    into = used.join(few, F.col("to_name") == F.col("seed")).select(F.col("from_name").alias("name"), F.lit("in").alias("kind"), F.col("seed").alias("via"), relation.alias("relation"))
    shelf = d.join(few, d["canonical_name"] == F.col("seed")).select("category", "seed")
    same = d.select(F.col("canonical_name").alias("name"), "category").join(F.broadcast(shelf), "category").select("name", F.lit("category").alias("kind"), F.col("seed").alias("via"), F.lit(None).cast("string").alias("relation"))
    weight = F.when(F.col("kind") == "out", F.when(F.col("relation") == "required", 4.0).otherwise(2.0)).when(F.col("kind") == "in", F.when(F.col("relation") == "required", 1.5).otherwise(0.75)).otherwise(0.5)
    signals = out.unionByName(into).unionByName(same).distinct().withColumn("w", weight)
    of = lambda k, v: F.array_sort(F.collect_list(F.when(F.col("kind") == k, v)))
    summed = signals.groupBy("name").agg(F.sum("w").alias("w"), of("out", F.struct("relation", "via")).alias("outbound_signals"), of("in", F.struct("relation", "via")).alias("inbound_signals"), of("category", F.col("via")).alias("shared_category_seeds"))
    none = spark.createDataFrame([], "name string, query_score double, query_coverage int, matched_terms array<string>")
    hits = S.ranked(corpus, index, query, max(limit * 4, limit), min_score).select(F.col("canonical_name").alias("name"), F.col("score").alias("query_score"), F.col("coverage").alias("query_coverage"), "matched_terms") if query else none
    rows = summed.join(hits, "name", "full_outer").join(few, F.col("name") == F.col("seed"), "left_anti")
    raw = F.coalesce("query_score", F.lit(0.0)) + F.coalesce("query_coverage", F.lit(0)) * 0.25 + F.coalesce("w", F.lit(0.0))
    rows = rows.withColumn("score", X.fixed3_column(raw)).withColumn("query_score", X.fixed3_column(F.col("query_score")))
    rows = rows.withColumns({"outbound_signals": F.coalesce("outbound_signals", F.array().cast("array<struct<relation:string,via:string>>")), "inbound_signals": F.coalesce("inbound_signals", F.array().cast("array<struct<relation:string,via:string>>")), "shared_category_seeds": F.coalesce("shared_category_seeds", F.array().cast("array<string>")), "matched_terms": F.array_sort(F.array_distinct(F.coalesce("matched_terms", F.array().cast("array<string>"))))})
    order = [F.col("score").desc(), F.size("outbound_signals").desc(), F.coalesce("query_score", F.lit(0.0)).desc(), X.locale_order(F.col("name"))]
    top = rows.orderBy(*order).limit(limit)
    shown = top.join(d.select(F.col("canonical_name").alias("name"), *SHOWN, "body_text"), "name")
    shown = shown.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return shown.select("rank", "name", X.read_path(F.col("name")).alias("read_path"), *SHOWN, "score", "query_score", "query_coverage", "matched_terms", "outbound_signals", "inbound_signals", "shared_category_seeds", X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("preview"))


def explain(corpus: Corpus, projection: DataFrame, hits: DataFrame | None) -> DataFrame:
    """Projected documents with the search evidence for them."""
    d = corpus.documents.select(F.col("canonical_name").alias("name"), *SHOWN, "body_text")
    none = corpus.spark.createDataFrame([], "name string, score double, coverage int, matched_terms array<string>")
    found = hits.select(F.col("canonical_name").alias("name"), "score", "coverage", "matched_terms") if hits is not None else none
    rows = projection.join(d, "name").join(found, "name", "left")
    return rows.select("name", X.read_path(F.col("name")).alias("read_path"), *SHOWN, "reason", "via", "depth", "read_layer", "apply_layer", "score", "coverage", F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"), X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("match_preview"))



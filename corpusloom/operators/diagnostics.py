"""Corpus health: validation, audit, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import graph as G
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.index import Index
from corpusloom.operators.tables import written


def _text(*parts: str) -> Column:
    """Literals and, in braces, columns."""
    return F.concat(*[F.coalesce(F.col(p[1:-1]), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts])


def _issue(rows: DataFrame, severity: str, kind: str, message: Column, **columns: str) -> DataFrame:
    names = ("skill_name", "path", "via", "target")
    more = [(F.col(columns[n]) if n in columns else F.lit(None).cast("string")).alias(n) for n in names]
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), message.alias("message"), *more)


def validate(corpus: Corpus) -> DataFrame:
    """severity, kind, message, skill_name, path, via, target of every issue."""
    d = corpus.documents
    out = _issue(corpus.malformed, "error", "malformed-frontmatter", _text("Malformed SKILL.md: ", "{reason}"), path="path")
    out = out.unionByName(_issue(corpus.duplicates, "error", "duplicate-canonical-name", _text("Duplicate canonical name '", "{canonical_name}", "' keeps ", "{kept_path}", " and drops ", "{dropped_path}", "."), skill_name="canonical_name", path="dropped_path"))
    out = out.unionByName(_issue(corpus.alias_conflicts.distinct(), "warning", "duplicate-alias", _text("Alias '", "{alias}", "' resolves to '", "{canonical_name}", "' and conflicts with '", "{conflicting_canonical_name}", "'."), skill_name="canonical_name", target="conflicting_canonical_name"))
    for relation, severity, word in (("requires", "error", "required"), ("recommends", "warning", "recommended")):
        links = d.select(F.col("canonical_name").alias("name"), "path", F.explode(relation).alias("target"))
        broken = links.join(corpus.aliases.select(F.col("alias").alias("target")), "target", "left_anti")
        out = out.unionByName(_issue(broken, severity, f"broken-{word}-relation", _text(f"{word.capitalize()} relation '", "{target}", "' from '", "{name}", "' does not resolve."), skill_name="name", path="path", via="name", target="target"))
    return out


def counts(issues: DataFrame) -> DataFrame:
    """One row: ok, errors, warnings."""
    one = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    return one.withColumn("ok", F.col("errors") == 0)


def audited(corpus: Corpus, edge_rows: DataFrame, seed_names: list[str]) -> DataFrame:
    """Issues of validation, cycles and orphans in no order, written."""
    names = F.array(*[F.lit(s) for s in seed_names]).cast("array<string>")
    everyone = corpus.documents.select(F.col("canonical_name").alias("name"), "path")
    rings = G.cycles(everyone.select("name"), G.arcs(edge_rows))
    alone = G.orphans(corpus, edge_rows)
    if seed_names:
        rings, alone = rings.where(F.arrays_overlap("members", names)), alone.where(F.array_contains(names, F.col("name")))
    first = rings.select(F.get("members", F.lit(0)).alias("name"), "members").join(everyone, "name")
    issues = validate(corpus).select("severity", F.lit("validation").alias("kind"), "message", "skill_name", "path", F.col("kind").alias("source_kind"), F.lit(None).cast("array<string>").alias("related_skills"))
    issues = issues.unionByName(first.select(F.lit("warning").alias("severity"), F.lit("cycle").alias("kind"), F.concat(F.lit("Relation cycle detected: "), F.array_join(F.concat("members", F.array("name")), " -> ")).alias("message"), F.col("name").alias("skill_name"), "path", F.lit(None).cast("string").alias("source_kind"), F.col("members").alias("related_skills")))
    issues = issues.unionByName(alone.join(everyone, "name").select(F.lit("info").alias("severity"), F.lit("orphan").alias("kind"), _text("Orphan skill '", "{name}", "' has no inbound or outbound relations.").alias("message"), F.col("name").alias("skill_name"), "path", F.lit(None).cast("string").alias("source_kind"), F.array("name").alias("related_skills")))
    return written(issues, "issues")


def totals(issues: DataFrame) -> DataFrame:
    """One row: issues of :func:`audited` by severity and kind, ok."""
    one = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("info"), F.count_if(F.col("kind") == "cycle").alias("cycles"), F.count_if(F.col("kind") == "orphan").alias("orphans"), F.count_if(F.coalesce("source_kind", F.lit("")).startswith("broken-")).alias("unresolved_relations"))
    return one.withColumn("ok", (F.col("errors") == 0) & (F.col("cycles") == 0))


def audit(corpus: Corpus, edge_rows: DataFrame, seed_names: list[str], limit: int) -> dict[str, DataFrame]:
    """Issues with their place (validation, cycles, orphans), counts, and the most linked documents."""
    limit = max(1, min(limit, 20))
    issues = audited(corpus, edge_rows, seed_names)
    weight = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    # a cycle's first name and an orphan's are on no other: their texts, which may be long, needn't be compared
    text = F.when(F.col("kind") == "validation", F.col("message")).otherwise("")
    ordered = G.numbered(issues, [weight.desc(), X.locale_order(F.col("kind")), X.locale_order(F.coalesce("skill_name", F.lit(""))), X.locale_order(text)])
    return {"issues": ordered, "counts": totals(issues), **most_linked(corpus, edge_rows, limit)}


def most_linked(corpus: Corpus, edge_rows: DataFrame, limit: int) -> dict[str, DataFrame]:
    """The documents with most relations to them and from them: all degrees, no walk."""
    degree = G.degrees(corpus, edge_rows)
    top = lambda a, b: degree.where(F.col(a) > 0).orderBy(F.col(a).desc(), F.col(b).desc(), X.locale_order(F.col("name"))).limit(max(1, min(limit, 20)))
    return {"top_inbound": top("inbound", "outbound"), "top_outbound": top("outbound", "inbound")}


def metrics(corpus: Corpus, index: Index | None = None) -> dict[str, DataFrame]:
    """Counts by category, source root and scope; relation counts, alias bearers, mean
    body length; top terms."""
    d = corpus.documents
    scope = F.coalesce(F.nullif(F.btrim("scope"), F.lit("")), F.lit("__unscoped__"))
    one = d.agg(F.count("*").alias("documents"), F.sum(F.size("requires")).alias("requires"), F.sum(F.size("recommends")).alias("recommends"), F.count_if(F.size("aliases") > 0).alias("alias_bearing"), F.coalesce(F.floor(F.avg(F.char_length("body_text")) + 0.5), F.lit(0)).alias("average_body_chars"))
    out = {
        "totals": one,
        "by_category": d.groupBy("category").count().orderBy(F.desc("count"), "category"),
        "by_source_root": d.groupBy("source_root").agg(F.count("*").alias("count")).withColumn("label", F.element_at(F.split("source_root", "/"), -1)).orderBy(F.desc("count"), "source_root"),
        "by_scope": d.groupBy(scope.alias("scope")).count().orderBy(F.desc("count"), "scope"),
    }
    if index is not None:
        out["top_terms"] = index.vocab.orderBy(F.desc("df"), "term").limit(20)
    return out


def complaint(missing: Column, hits: Column, limit: int) -> Column:
    """What a search with few or many results points to."""
    return F.when(missing > 0, "drift").when(hits == 0, "miss").when(hits >= limit, "overload").otherwise("low-value")


def complaint_of(missing: int, hits: int, limit: int) -> str:
    """:func:`complaint` of one request."""
    return "drift" if missing else "miss" if not hits else "overload" if hits >= limit else "low-value"

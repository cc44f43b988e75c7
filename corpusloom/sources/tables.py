"""Corpora from tables: documents with labels as records with names and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import Corpus, Settings, build

#: Roots of scopes, some within others, in order of rank.
SCOPE_ROOTS = {"first": ["/corpus/src1", "/corpus/src2"], "second": ["/corpus/src1/doc-1", "/corpus/src3"], "rest": ["/corpus"]}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records by rule: names from ids, relations by arithmetic on ids (a
    tree of requirements, some broken, and a ring of recommendations)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # one row, so the join is with a constant
    count = docs.agg(F.count("*").alias("n_docs"))
    d = docs.join(labels, "doc_id", "left").join(F.broadcast(count), F.lit(True))
    i = F.col("doc_id")
    name = lambda x: F.concat(F.lit("doc-"), x.cast("string"))
    root = F.concat(F.lit("/corpus/"), F.col("source"))
    third = F.floor(i / 3).cast("long")
    requires = F.array_compact(F.array(F.when((i % 3 == 0) & (i > 0), name(third)), F.when(i % 11 == 0, F.concat(F.lit("missing-"), i.cast("string")))))
    return d.select(
        i.alias("ordinal"), name(i).alias("skill_id"), name(i).alias("canonical_name"), F.concat(root, F.lit("/"), name(i), F.lit("/SKILL.md")).alias("path"), root.alias("source_root"), F.lit(None).cast("string").alias("scope"),
        F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80).alias("title"), F.col("lang").alias("category"), F.lit("").alias("description"), F.array("lang").alias("keywords"),
        F.array_compact(F.array(F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string")))).alias("tags"),
        F.array(F.concat(F.lit("alias-"), F.floor(i / 2).cast("long").cast("string"))).alias("aliases"), requires.alias("requires"), F.array(name((i * 7 + 1) % F.col("n_docs"))).alias("recommends"),
        F.col("text").alias("body_text"), F.lit(None).cast("string").alias("version"), i.cast("double").alias("mtime_ms"),
    )


def settings() -> Settings:
    return Settings(scope_priority=["first", "second"], scope_roots=SCOPE_ROOTS)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return build(records(spark, sf_dir), settings())


def purchase_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger graph: within an order the part of a line leads to that of the next."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    part = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string"))
    return lines.join(following, ["l_orderkey", "l_linenumber"]).select(part("l_partkey").alias("u"), part("to").alias("v")).distinct()


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mtime_ms, content: a Markdown file with frontmatter for each document, its
    fields under several names and in several forms, some repeated, some malformed."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 13 == 0, F.lit("")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("name: Skill_Doc "), i, F.lit(".md\n"))).otherwise(F.concat(F.lit("NAME:  'Doc  "), i, F.lit("'\n")))
    lists = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tags: [One, 'two', One]\nalias:\n- A "), i, F.lit("\n  -B\n\nrequire: a, b;a\nrelated: [b, C d]\n"))).otherwise(F.concat(F.lit("tag: "), F.col("source"), F.lit("\naliases: \n - \"Q "), i, F.lit("\"\nnote\n- lost\ndepends_on: [X y, 'z']\nrecommends: x-Y\n")))
    front = F.concat(F.lit("---\n"), name, F.lit("summary: About "), i, F.lit("\ngroup: "), F.coalesce("lang", F.lit("")), F.lit("\n"), lists, F.lit("skill_version: 1."), i, F.lit("\n---\n"))
    heading = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("intro\n##  Heading "), i, F.lit("  \n"))).otherwise(F.lit(""))
    content = F.concat(F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(front), heading, F.coalesce("text", F.lit("")))
    content = F.when(F.col("doc_id") % 7 == 0, F.replace(content, F.lit("\n---\n"), F.lit("\r\n---\r\n"))).otherwise(content).cast("binary")
    content = F.when(F.col("doc_id") % 101 == 0, F.concat(content, F.lit(bytes([255, 254])))).otherwise(content)
    return d.select(F.concat(F.lit("/files/folder-"), i, F.lit("/SKILL.md")).alias("path"), F.col("doc_id").cast("double").alias("mtime_ms"), content.alias("content"))


def shelf(spark: SparkSession, sf_dir: str) -> Corpus:
    """Parts as short documents without a scope of their own, some of them on the registry."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    root = F.concat(F.lit("/shelf/"), F.col("p_partkey") % 3)
    none = F.array().cast("array<string>")
    d = p.select(
        F.col("p_partkey").cast("long").alias("ordinal"), name.alias("skill_id"), name.alias("canonical_name"), F.concat(root, F.lit("/"), name).alias("path"), root.alias("source_root"), F.lit(" ").alias("scope"),
        F.when(F.col("p_partkey") % 7 == 0, "Skill registry").otherwise("Part").alias("title"), F.col("p_type").alias("category"), F.lit("").alias("description"), F.array("p_type").alias("keywords"), none.alias("tags"), none.alias("aliases"),
        none.alias("requires"), none.alias("recommends"), F.col("p_name").alias("body_text"), F.lit(None).cast("string").alias("version"), F.lit(0.0).alias("mtime_ms"),
    )
    none_of = spark.createDataFrame([], "path string, reason string")
    owner = d.select(F.col("canonical_name").alias("alias"), "canonical_name")
    return Corpus(d, owner, none_of, none_of, none_of, Settings(scope_priority=["near"], scope_roots={"far": ["/shelf", "/shelf/1"], "near": ["/shelf/2/"], "also": ["/shelf/1"]}))

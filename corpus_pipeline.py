"""The corpus pipeline: language ID, quality rules, near-duplicates, benchmark
decontamination, packing. Each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of
``documents``; the last returns where each part of each document lies in the
training sequences. Its rows depend on learned models, hashes and packing, which
SQL can't express; each stage's operator has a brute-force test of its own, and a test
holds this chain to the stages called one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, langid, packing, rules, simhash
from corpusloom.llm.common import written
from corpusloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; lang becomes the recognised one."""
    ship(spark)
    return langid.stage(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rule nor are outliers of their language and source."""
    ship(spark)
    return rules.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.stage(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    ship(spark)
    return packing.stage(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""Postings kept up to date from a stream of documents.

Each micro-batch becomes a delta under its batch id: the documents in it (also those
without tokens) and their postings; writing one again replaces it, so a replayed batch
counts once. A document that comes again replaces its earlier version, and one that
comes with a null body is deleted. Within a batch the record with the greatest time
(null: before all others), then path, stands; between batches the later batch does,
whatever its records' times. Batches are folded into one by :func:`compact`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.index import postings

_SEEN, _ROWS = "skill_id string, gone boolean, batch_id long", "term string, skill_id string, n_tokens long, tf long, wtf long, batch_id long"


def follow(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of document records (file source or other) as it is available."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        # a struct is never null, so a document without a time is one all the same
        age = F.struct("mtime_ms", "path")
        latest = batch.groupBy("skill_id").agg(F.max_by(F.struct(*batch.columns), age).alias("d")).select("d.*").persist()
        try:
            postings(latest.where("body_text is not null")).write.mode("overwrite").parquet(f"{folder}/postings/batch_id={batch_id}")
            # last, as it is what makes the batch count
            latest.select("skill_id", F.isnull("body_text").alias("gone")).write.mode("overwrite").parquet(f"{folder}/seen/batch_id={batch_id}")
        finally:
            latest.unpersist()

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    seen = spark.read.schema(_SEEN).parquet(f"{folder}/seen")
    return seen.groupBy("skill_id").agg(F.max(F.struct("batch_id", "gone")).alias("x")).where("not x.gone").select("skill_id", "x.batch_id")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """term, skill_id, n_tokens, tf, wtf of every document's latest batch."""
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/postings")
    return rows.join(_latest(spark, folder), ["skill_id", "batch_id"]).select("term", "skill_id", "n_tokens", "tf", "wtf")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """What is current, as a single batch (-1) of a new folder; a stream that goes on
    there adds to it."""
    rows, seen = current(spark, folder), _latest(spark, folder).select("skill_id", F.lit(False).alias("gone"))
    rows.write.parquet(f"{target}/postings/batch_id=-1")
    seen.write.parquet(f"{target}/seen/batch_id=-1")

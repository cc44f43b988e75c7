"""Tables that cut lineage, and small helpers shared by operators."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Called by :func:`clear`: what keeps frames that stand on written tables forgets them.
FORGET: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset
    in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that sends nothing to the driver: without this hint each round of
    a loop broadcasts tables of up to ``spark.sql.autoBroadcastJoinThreshold``. Its keys are
    about unique and become a hash table in each partition, so arcs aren't sorted."""
    return df.hint("shuffle_hash")


def clear(spark: SparkSession) -> None:
    """Delete what this application has written with :func:`written`. For the end of a
    job: frames that stand on it can't be read any more."""
    for forget in FORGET:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def identity(spark: SparkSession, *paths: str) -> tuple:
    """What tells whether the files below paths have changed: number, bytes, latest time."""
    conf, found = spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        held = path.getFileSystem(conf).listStatus(path)
        found.append((len(held), sum(f.getLen() for f in held), max((f.getModificationTime() for f in held), default=0)))
    return tuple(found)

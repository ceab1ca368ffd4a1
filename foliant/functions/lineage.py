"""The folder that driver and executors share, and results kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where that is unset (on one machine), a new folder of the session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, in the same partitions and order, kept in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)

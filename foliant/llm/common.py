"""What the operators of this package share: word rules, let-bindings and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters (in Java, what \\s stands for); what lies between them is a word.
WHITE_SPACE = r"\s+"


def words_of(text: Column | str) -> Column:
    """The words of a text, in order; a null or blank text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda, an inlined expression would run at each step."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in spark.checkpoint.dir.

    Where that is unset (tests on one machine), a new local folder is named once for the session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation of what led to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows; Python workers get so many of them at a time, as texts are long, unless the session says else."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(key, default) == default:
        df.sparkSession.conf.set(key, str(rows))
    return df

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one only where that is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the shared folder, so that lost executors cost no earlier stage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)

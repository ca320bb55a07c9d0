"""A SparkSession with the settings that the library is tested with; on a cluster the submitted settings win."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "papyrus", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow on. Without a master the one given to spark-submit (or local[*]) holds."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app).config(map=settings | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found or known.isDefined():
        return found or known.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

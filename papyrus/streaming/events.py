"""Event-time streams over attempt logs, and their batch twins.

The stream functions take and return streaming DataFrames; run() drives one over what is there now and gives the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from papyrus.functions.stats import ratio
from papyrus.session import forget, shared_folder


#: The time of the row that ends a finite stream; nothing real is as late.
END = "9999-01-01 00:00:00"


def source(spark: SparkSession, sf_dir: str, name: str = "events", files_a_batch: int = 64, end: bool = True) -> DataFrame:
    """The events as a stream of Parquet files, at most ``files_a_batch`` in a batch, with a timestamp that a watermark takes.

    A watermark only moves on with rows, so what is open at the last one would stay so. With ``end`` one more row, of the time END and with nulls,
    follows when the last file is read: it closes whatever is open, and is itself left open. The functions below leave it out.
    """
    path = f"{sf_dir}/{name}.parquet"
    read = spark.read.parquet(path)
    schema = read.schema
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path[:-1] + "[t]")
    if end:
        last = f"{shared_folder(spark)}/stream-end-{uuid.uuid4().hex}"
        empty = spark.createDataFrame([], schema).coalesce(1)
        closing = spark.createDataFrame([tuple(None for _ in schema)], schema).withColumn("ts", F.lit(END).cast(schema["ts"].dataType))
        batches = -(-len(read.inputFiles()) // files_a_batch)
        for _ in range(batches):  # as many empty files, so that the row comes in the batch after the last of the given files
            empty.write.mode("append").parquet(last)
        closing.coalesce(1).write.mode("append").parquet(last)
        given = given.unionByName(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(last))
    return given.withColumn("ts", F.col("ts").cast("timestamp"))


def _real(rows: DataFrame, start: str) -> DataFrame:
    """rows without those of the end; told by their time, as any other condition would be moved in front of the watermark."""
    return rows.where(F.col(start) < F.lit(END).cast("timestamp") - F.expr("INTERVAL 1 DAY"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each closed window."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return _real(w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"), "start")


def sliding(events: DataFrame, width: str = "1 hour", every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n, mean) of each window; values have two digits after the point, so means are rounded from exact fractions."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = w.groupBy(F.window("ts", width, every).alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return _real(grouped.select(F.col("w.start").alias("start"), "n", ratio(F.col("cents"), 100 * F.col("n"), 4).alias("mean")), "start")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) of each session."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return _real(w.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("s.start").alias("start"), "n", "total"), "start")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late)
    return (w.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else w.dropDuplicates(["event_id"])).select("event_id", "event_type", "ts").where(F.col("event_id").isNotNull())


def breaker(events: DataFrame, threshold: int = 3) -> DataFrame:
    """(user_id, opened, attempts): how often a user's failures (value under 10) came ``threshold`` in a row; state is three numbers a user.

    A user's rows of a batch are sorted in memory: the source's files_a_batch bounds them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened, n = state.get if state.exists else (0, 0, 0)
        for ok in pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"] >= 10:
            run = 0 if ok else run + 1
            opened, n = opened + (run == threshold), n + 1
        state.update((run, opened, n))
        yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "attempts": [n]})

    keyed = events.select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, opened long, attempts long", "run long, opened long, n long", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now. Rows and state go to a new place in the shared folder, so a lost executor or
    driver costs no finished batch and nothing is gathered in memory. In update mode the last row of each ``key`` counts."""
    spark, place = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/rows").start().awaitTermination()
        forget(spark, f"{place}/state")
        return spark.read.schema(stream.schema).parquet(f"{place}/rows")
    writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")).start().awaitTermination()
    forget(spark, f"{place}/state")
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{place}/rows")
    return found.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("r")).select(key, "r.*")

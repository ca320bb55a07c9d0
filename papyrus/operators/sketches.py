"""Distinct counts as state that merges: a sketch for each day, written once; any range of days is the union of its sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2 ** LG_K registers; the standard error is about 0.83 / sqrt(2 ** LG_K): 1.3 %.
LG_K = 12


def add_days(rows: DataFrame, path: str, day: str = "day", item: str = "item", lg_k: int = LG_K) -> None:
    """Adds the sketches of the days of rows to the state at ``path``; what is there already is neither read nor rewritten.

    Rows of a day that come later are another sketch of it: sketches merge, so a day may have several.
    """
    rows.groupBy(F.col(day).alias("day")).agg(F.hll_sketch_agg(item, lg_k).alias("sketch"), F.count("*").alias("n")).write.mode("append").parquet(path)


def distinct_over(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(first, last, n, distinct) for ranges (first, last: days, both included): rows and the estimated number of distinct items. Reads one small row a day, no item."""
    state = spark.read.parquet(path)
    met = ranges.join(state, F.col("day").between(F.col("first"), F.col("last")), "left")
    merged = met.groupBy("first", "last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("first", "last", "n", F.when(F.col("n") > 0, F.hll_sketch_estimate("sketch")).otherwise(0).alias("distinct"))

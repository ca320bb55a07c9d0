"""Kolmogorov-Smirnov distance of a column from the normal law with its own mean and deviation, without a task that sees all rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Buckets of values that ranks are counted in; as many rows are summed up over all of them.
BUCKETS = 512


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in z]))


def kolmogorov_p(d: float, n: int) -> float:
    """P(D > d) by the limiting series; near 0 distance it is 1."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def normality(rows: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: n, mean, std (population), d (exact), p. Null and not finite values are left out; without any, or where all are equal, d and p are null.

    Equal values are one row first. Their ranks are running counts within buckets of values, whose bounds are approximate quantiles (which only
    decide how evenly the work is dealt), and start from the sums of the buckets before. p takes the law as given; as it is
    fitted to the data itself, the true p is lower.
    """
    spark = rows.sparkSession
    x = rows.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    one = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).first()  # one row
    schema = "n long, mean double, std double, d double, p double"
    if not one["n"] or not one["std"]:
        return spark.createDataFrame([(one["n"], one["mean"], one["std"], None, None)], schema)
    counts = x.groupBy("x").agg(F.count("*").alias("c"))
    bounds = sorted(set(counts.approxQuantile("x", [k / buckets for k in range(1, buckets)], 0.5 / buckets)))  # at most ``buckets`` numbers
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("x"))) if bounds else F.lit(0)
    dealt = counts.withColumn("b", place)
    sums = dealt.groupBy("b").agg(F.sum("c").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("x"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(before), ["b"])  # a row for each bucket
    high = (F.col("before") + F.col("upto")) / one["n"]
    law = normal_cdf((F.col("x") - one["mean"]) / one["std"])
    d = ranked.select(high.alias("high"), (F.col("c") / one["n"]).alias("step"), law.alias("f")).agg(F.max(F.greatest(F.abs(F.col("high") - F.col("f")), F.abs(F.col("high") - F.col("step") - F.col("f")))).alias("d")).first()["d"]
    return spark.createDataFrame([(one["n"], one["mean"], one["std"], d, kolmogorov_p(d, one["n"]))], schema)

"""Numbers over whole tables without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, id_col: str, width: int = 1 << 16, name: str = "row_no") -> DataFrame:
    """df with 1, 2, 3, ... in the order of a unique integer id.

    Rows are numbered within blocks of ids; a block's start is the running sum of the blocks before it, which is a window
    over one row for each ``width`` ids only.
    """
    block = F.floor(F.col(id_col) / width).alias("_block")
    sizes = df.groupBy(block).agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    own = df.withColumn("_block", F.floor(F.col(id_col) / width)).withColumn("_in", F.row_number().over(Window.partitionBy("_block").orderBy(id_col)))
    return own.join(before, ["_block"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def top_k(df: DataFrame, count_col: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the highest counts, ties by the given columns ascending."""
    return df.orderBy(F.col(count_col).desc(), *ties).limit(k)


def top_k_by(df: DataFrame, groups: list[str], count_col: str, k: int, *ties: str, name: str = "rank") -> DataFrame:
    """As top_k within each group, with the rank."""
    w = Window.partitionBy(*groups).orderBy(F.col(count_col).desc(), *ties)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def histogram(df: DataFrame, value: str, bins: int, up_to_distinct: bool = False) -> DataFrame:
    """(bin, low, n) of equal-width bins from the minimum to the maximum, the last one closed; bins without rows are left out.

    With up_to_distinct there are no more bins than distinct values.
    """
    x = F.col(value).cast("double")
    agg = [F.min(x).alias("lo"), F.max(x).alias("hi"), (F.least(F.lit(bins), F.count_distinct(x)) if up_to_distinct else F.lit(bins)).alias("bins")]
    bounds = df.where(x.isNotNull()).agg(*agg)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.col("bins") - 1)).otherwise(0).cast("int")
    # bounds has one row
    placed = df.where(x.isNotNull()).select(value).join(F.broadcast(bounds)).select(place.alias("bin"), "lo", width.alias("width"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.first(F.col("lo") + F.col("bin") * F.col("width")), 4).alias("low"))


def slope(y: str, x: str) -> Column:
    return F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole of integers (whole over 0, part not negative), rounded half up from the exact fraction; null where whole is 0."""
    scale = 10**digits
    return F.floor(F.try_divide(part * (2 * scale) + whole, whole * 2)) / F.lit(float(scale))

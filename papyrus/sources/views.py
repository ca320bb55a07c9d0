"""The model's tables as views of the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: pmid, title (first line), abstract, journal, keyword."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("PMID:"), F.col("doc_id").cast("string")).alias("pmid"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"), F.col("lang").alias("keyword"))


def dated_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as papers with a date: pmid, pub_date, journal (the priority), year."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pmid"), F.to_date("o_orderdate").alias("pub_date"), F.col("o_orderpriority").alias("journal"), F.year("o_orderdate").alias("year"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as fetch attempts: strategy, paper, attempt time, success (no error and a value of 10 or more)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("strategy"), F.col("user_id").alias("paper"), F.col("ts").cast("timestamp").alias("ts"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("value") >= 10).alias("success"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with their documents as scores: paper_id, journal, analysis_type, scores (name -> 0 to 10), seconds."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), ["doc_id"])
    named = F.create_map(
        F.lit("overall_quality"), (F.col("quality") * 4 + F.pmod("doc_id", F.lit(7))).cast("double"),
        F.lit("clarity"), (10 - F.col("toxic") * 5 - F.pmod("doc_id", F.lit(5))).cast("double"),
        F.lit("innovation"), (F.pmod("doc_id", F.lit(11)) * 0.9).cast("double"),
    )
    return joined.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("journal"), F.col("lang").alias("analysis_type"), named.alias("scores"), (F.col("n_chars") / 1000.0).alias("seconds"))

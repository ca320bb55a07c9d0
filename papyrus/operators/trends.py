"""Years, journals and keywords over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.functions.stats import slope, top_k, top_k_by


def yearly_counts(papers: DataFrame, first_year: int = 1990) -> DataFrame:
    return papers.where(F.col("year") >= first_year).groupBy("year").agg(F.count("*").alias("n"))


def slope_and_peak(papers: DataFrame) -> DataFrame:
    """One row: least-squares slope of the yearly counts, the (first) peak year and its count."""
    y = yearly_counts(papers)
    return y.agg(F.round(slope("n", "year"), 6).alias("slope"), F.max(F.struct("n", (-F.col("year")).alias("y"))).alias("p"), F.count("*").alias("years")).select("slope", (-F.col("p.y")).alias("peak_year"), F.col("p.n").alias("peak_n"), "years")


def journal_trends(papers: DataFrame, k: int = 10) -> DataFrame:
    """The k journals with most papers: slope of their yearly counts (null with one year) and the count of their last year."""
    best = top_k(papers.groupBy("journal").agg(F.count("*").alias("total")), "total", k, "journal")
    counts = papers.groupBy("journal", "year").agg(F.count("*").alias("n")).join(F.broadcast(best), ["journal"])
    return counts.groupBy("journal", "total").agg(F.when(F.count("*") > 1, F.round(slope("n", "year"), 6)).alias("slope"), F.max_by("n", "year").alias("recent"))


def keyword_evolution(rows: DataFrame, k: int = 10) -> DataFrame:
    """rows: year, keywords (separated by spaces or commas) -> the k most frequent keywords of each year."""
    words = rows.select("year", F.explode(F.split(F.trim("keywords"), r"[\s,]+")).alias("keyword")).where("keyword <> ''")
    return top_k_by(words.groupBy("year", "keyword").agg(F.count("*").alias("n")), ["year"], "n", k, "keyword")


def common_keywords(rows: DataFrame, k: int = 10) -> DataFrame:
    words = rows.select(F.explode(F.split("keywords", r"[\s,]+")).alias("keyword")).where("keyword <> ''")
    return top_k(words.groupBy("keyword").agg(F.count("*").alias("n")), "n", k, "keyword")


def journal_year_matrix(papers: DataFrame, years: list[int], k: int = 10) -> DataFrame:
    """A column for each year, for the k journals with most papers."""
    best = top_k(papers.groupBy("journal").agg(F.count("*").alias("total")), "total", k, "journal").select("journal")
    wide = papers.join(F.broadcast(best), ["journal"]).groupBy("journal").pivot("year", years).agg(F.count(F.lit(1)))
    return wide.select("journal", *[F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias(f"y{y}") for y in years])


def dataset_summary(papers: DataFrame) -> DataFrame:
    """One row: total, journals, first and last year, most prolific journal, most active year (ties: the smallest)."""
    by = papers.groupBy("journal", "year").agg(F.count("*").alias("n"))
    journal = by.groupBy("journal").agg(F.sum("n").alias("n")).agg(F.min_by("journal", F.struct((-F.col("n")).alias("n"), "journal")).alias("top_journal"), F.count("*").alias("journals"))
    year = by.groupBy("year").agg(F.sum("n").alias("n")).agg(F.min_by("year", F.struct((-F.col("n")).alias("n"), "year")).alias("top_year"), F.sum("n").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return journal.join(F.broadcast(year))  # one row each


def top_journals(papers: DataFrame, k: int = 10) -> DataFrame:
    named = papers.where("journal is not null and trim(journal) <> '' and journal <> 'Unknown'")
    return top_k(named.groupBy("journal").agg(F.count("*").alias("n")), "n", k, "journal")


def years_in_text(rows: DataFrame, text: str) -> DataFrame:
    """Counts of the first 20xx of each text."""
    return rows.select(F.regexp_extract(text, r"20\d{2}", 0).alias("y")).where("y <> ''").groupBy(F.col("y").cast("int").alias("year")).agg(F.count("*").alias("n"))

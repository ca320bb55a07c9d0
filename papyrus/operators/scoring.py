"""Scores in responses and of papers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions.stats import ratio

# Weights of the composite score.
WEIGHTS = {"overall_quality": 0.25, "methodology_rigor": 0.20, "innovation": 0.20, "field_significance": 0.15, "reproducibility": 0.10, "clarity": 0.10}
OTHER_WEIGHT = 0.05


def marked_scores(response: Column) -> Column:
    """Map of the [SCORE:name:number] marks; of a name's marks the last that is a number counts."""
    names = F.regexp_extract_all(response, F.lit(r"\[SCORE:([^:]+):([0-9.]+)\]"), F.lit(1))
    values = F.regexp_extract_all(response, F.lit(r"\[SCORE:([^:]+):([0-9.]+)\]"), F.lit(2))
    entries = F.filter(F.zip_with(names, values, lambda n, v: F.struct(F.trim(n).alias("k"), v.try_cast("double").alias("v"))), lambda e: e["v"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


# How a score without a mark is written.
FALLBACK = [r"(\d+(?:\.\d+)?)\s*/\s*10", r"(\d+(?:\.\d+)?)\s*out\s*of\s*10", r"score.*?(\d+(?:\.\d+)?)", r"rating.*?(\d+(?:\.\d+)?)"]


def fallback_score(response: Column) -> Column:
    """Mean of the numbers up to 10 in x/10, x out of 10, score ... x and rating ... x; 5 without any."""
    low = F.lower(F.coalesce(response, F.lit("")))
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in FALLBACK]))
    values = F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: v <= 10)
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), F.size(values)), F.lit(5.0))


def exploded(scores: DataFrame) -> DataFrame:
    return scores.select("paper_id", "journal", "analysis_type", "seconds", F.explode("scores").alias("name", "score"))


def summary(scores: DataFrame) -> DataFrame:
    """Per analysis type and score name: n, mean, population deviation, minimum, maximum, median."""
    s = F.col("score")
    return exploded(scores).groupBy("analysis_type", "name").agg(
        F.count("*").alias("n"), F.round(F.avg(s), 4).alias("mean"), F.round(F.stddev_pop(s), 4).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"),
        F.round(F.median(s), 4).alias("median"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.count_distinct("paper_id").alias("papers"),
    )


def statistics(scores: DataFrame) -> DataFrame:
    """(what, name, n, mean, std): over score names, analysis types and seconds."""
    e = exploded(scores)
    agg = [F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("std")]
    by_name = e.select(F.lit("score").alias("what"), "name", F.col("score").alias("x"))
    by_type = scores.select(F.lit("seconds").alias("what"), F.col("analysis_type").alias("name"), F.col("seconds").alias("x"))
    return by_name.unionByName(by_type).groupBy("what", "name").agg(*agg)


def exported(results: DataFrame, folder: str) -> DataFrame:
    """results written as JSON lines to a new place in folder (one file a task), and read back with the same columns."""
    path = f"{folder}/{uuid.uuid4().hex}"
    results.write.json(path)
    return results.sparkSession.read.schema(results.schema).json(path)


def ranges(scores: DataFrame) -> DataFrame:
    """(name, n, low, high, papers) of each score."""
    return exploded(scores).groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_distinct("paper_id").alias("papers"))


def usage(results: DataFrame) -> DataFrame:
    """(what, name, n, mean_seconds, total_seconds, fastest, slowest) over all results, each analysis type and each backend. results: analysis_type, backend, seconds."""
    sets = results.groupingSets([[], [F.col("analysis_type")], [F.col("backend")]], F.col("analysis_type"), F.col("backend"))
    milli = F.round(F.col("seconds") * 1000).cast("long")  # whole numbers: sums have no order
    out = sets.agg(F.grouping("analysis_type").alias("g"), F.grouping("backend").alias("h"), F.count("*").alias("n"), F.sum(milli).alias("total"), F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"))
    what = F.when(F.col("g") == 0, "type").when(F.col("h") == 0, "backend").otherwise("all")
    return out.select(what.alias("what"), F.coalesce("analysis_type", "backend", F.lit("")).alias("name"), "n", ratio(F.col("total"), F.col("n") * 1000, 4).alias("mean_seconds"), (F.col("total") / 1000).alias("total_seconds"), "fastest", "slowest")


def export_with_statistics(scores: DataFrame, results: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The results, and the statistics of their scores and of their use, each written as JSON lines to a new place in folder and read back."""
    facts = usage(results).select("what", "name", "n", F.col("mean_seconds").alias("mean"), F.lit(None).cast("double").alias("std")).unionByName(statistics(scores).where("what = 'score'"))
    return exported(exploded(scores), folder), exported(facts, folder)


def top_by_score(scores: DataFrame, name: str, k: int) -> DataFrame:
    return scores.where(F.map_contains_key("scores", name)).select("paper_id", F.round(F.element_at("scores", name), 6).alias("score")).orderBy(F.col("score").desc(), "paper_id").limit(k)


def composites(scores: DataFrame) -> DataFrame:
    """(paper_id, journal, composite): weighted mean over a paper's score names; of a name's analysis types the last counts."""
    last = Window.partitionBy("paper_id", "name").orderBy(F.col("analysis_type").desc())
    one = exploded(scores).withColumn("rn", F.row_number().over(last)).where("rn = 1")
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("name")), F.lit(OTHER_WEIGHT))
    return one.withColumn("w", weight).groupBy("paper_id").agg(F.max("journal").alias("journal"), F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6).alias("composite"))


def journal_boxes(ranking: DataFrame, least: int = 2) -> DataFrame:
    """Five numbers of the composites of each journal (name cut at 20 characters) with ``least`` papers."""
    five = F.percentile("composite", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = ranking.groupBy(F.substring("journal", 1, 20).alias("journal")).agg(F.count("*").alias("n"), F.min("composite").alias("low"), five.alias("q"), F.max("composite").alias("high")).where(F.col("n") >= least)
    return one.select("journal", "n", "low", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "high")


def response_statistics(responses: DataFrame) -> DataFrame:
    """responses: role, text, turn -> per role: n, mean length, mean turn and their correlation (null for two rows or fewer, or where either is constant)."""
    n, turn = F.length("text").cast("double"), F.col("turn").cast("double")
    corr = F.try_divide(F.covar_pop(n, turn), F.stddev_pop(n) * F.stddev_pop(turn))
    return responses.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_length"), F.round(F.avg("turn"), 4).alias("mean_turn"), F.when(F.count("*") > 2, F.round(corr, 4)).alias("corr"))


def density(ranking: DataFrame, value: str = "composite", points: int = 21, high: float = 10.0) -> DataFrame:
    """(place, density): Gaussian kernel density of the values at ``points`` places from 0 to ``high``; bandwidth by Scott's rule.

    The places are a fixed list inside each row; a task's rows are summed before anything is shuffled.
    """
    width = ranking.agg((F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("h"), F.count(value).alias("n"))
    places = F.explode(F.array(*[F.lit(high * k / (points - 1)) for k in range(points)]))
    z = (F.col("place") - F.col(value)) / F.col("h")
    rows = ranking.where(F.col(value).isNotNull()).select(value, places.alias("place")).join(F.broadcast(width))  # width is one row
    return rows.groupBy("place").agg(F.round(F.sum(F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * F.sqrt(2 * F.pi())), 4).alias("density"))

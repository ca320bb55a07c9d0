"""Derived measures: quality components, impact, maturity, completeness, phase trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.functions.stats import slope


def corpus_facts(papers: DataFrame, rated: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of the numbers that the measures below take: availability, topics, coherence, words, entity_types, polarity.

    Journals stand for topics, languages for entity types; a topic's coherence is the share of its five best terms among its ten best.
    """
    a = papers.agg(F.round(F.avg(F.col("abstract").isNotNull().cast("double")) * 100, 6).alias("availability"), F.count_distinct("keyword").alias("entity_types"))
    c = terms.groupBy("journal").agg(F.try_divide(F.sum(F.when(F.col("rank") <= 5, F.col("n"))), F.sum("n")).alias("c")).agg(F.round(F.avg("c"), 6).alias("coherence"), F.count("*").alias("topics"))
    w = terms.agg(F.count_distinct("term").alias("words"))
    p = rated.agg(F.round(F.avg("polarity"), 6).alias("polarity"))
    return a.join(F.broadcast(c)).join(F.broadcast(w)).join(F.broadcast(p))  # one row each


def _cap(x: Column, most: float) -> Column:
    return F.least(x, F.lit(most))


def quality_components(facts: DataFrame, phases_done: float = 100.0) -> DataFrame:
    """(component, value): five of at most 100, their mean, and the completeness measures."""
    parts = {
        "availability": _cap(F.col("availability"), 100.0), "coherence": _cap(F.col("coherence") * 100, 100.0), "topics": _cap(F.col("topics") * 10.0, 100.0),
        "balance": F.coalesce(_cap((1 - F.abs("polarity")) * 100, 100.0), F.lit(50.0)), "phases": _cap(F.lit(phases_done), 100.0),
    }
    mean = sum(parts.values(), F.lit(0.0)) / len(parts)
    complete = {"c_availability": parts["availability"], "c_topics": parts["topics"], "c_sentiment": F.lit(100.0), "c_entities": _cap(F.col("entity_types") * 20.0, 100.0), "c_clusters": F.lit(50.0)}
    impact = {"i_words": _cap(F.col("words") / 100.0, 1.0), "i_entities": _cap(F.col("entity_types") / 10.0, 1.0), "i_topics": F.when(F.col("topics") > 3, 1.0).when(F.col("topics") > 1, 0.5).otherwise(0.0), "i_balance": F.coalesce(1 - F.abs("polarity"), F.lit(0.5))}
    rows = parts | {"overall": mean} | complete | {"completeness": sum(complete.values(), F.lit(0.0)) / len(complete)} | impact
    return facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.round(v.cast("double"), 4).alias("value")) for k, v in rows.items()])).alias("r")).select("r.*")


def citation_split(facts: DataFrame, quality: float) -> DataFrame:
    """One row: expected shares of high, medium, low and niche impact, from topics and a quality from 0 to 100."""
    high = _cap(F.col("topics") * quality / 100.0, 40.0)
    medium = _cap((100 - F.col("high")) * 0.4, 35.0)
    low = _cap((100 - F.col("high") - F.col("medium")) * 0.6, 20.0)
    return facts.select(high.alias("high")).withColumn("medium", medium).withColumn("low", low).withColumn("niche", 100 - F.col("high") - F.col("medium") - F.col("low"))


def phase_trend(papers: DataFrame) -> DataFrame:
    """dated papers: slope of the yearly counts relative to their mean, and its label."""
    by = papers.groupBy("year").agg(F.count("*").alias("n"))
    one = by.agg(slope("n", "year").alias("s"), F.avg("n").alias("m"))
    rel = F.coalesce(F.try_divide("s", "m"), F.lit(0.0))
    return one.select(F.round(rel, 6).alias("relative_slope"), F.when(rel > 0.01, "Improving").when(rel < -0.01, "Declining").otherwise("Stable").alias("label"))


# From which quality a work counts as reproducible, and how far; from which score a side is mature or developing.
REPRODUCIBLE = [(70, 0.8), (40, 0.5)]
LEAST_REPRODUCIBLE, UNRATED, TOPICS_WANTED = 0.3, 0.3, 10
MATURE, DEVELOPING = 0.8, 0.5


def maturity(state: DataFrame) -> DataFrame:
    """(metric, value, level) of the five sides of maturity, 1 at most each. state, one row: quality (0 to 100), topics, share (of papers that were got), rated (whether there is a sentiment)."""
    q = F.col("quality")
    reproducible = F.when(q > REPRODUCIBLE[0][0], REPRODUCIBLE[0][1]).when(q > REPRODUCIBLE[1][0], REPRODUCIBLE[1][1]).otherwise(LEAST_REPRODUCIBLE)
    sides = {"methodology": q / 100, "theory": F.col("topics") / TOPICS_WANTED, "evidence": F.coalesce("share", F.lit(0.0)), "statistics": F.when(F.col("rated"), 1.0).otherwise(UNRATED), "reproducibility": reproducible}
    rows = state.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(_cap(v.cast("double"), 1.0), 4).alias("value")) for k, v in sides.items()])).alias("r")).select("r.*")
    return rows.withColumn("level", F.when(F.col("value") >= MATURE, "mature").when(F.col("value") >= DEVELOPING, "developing").otherwise("emerging"))


def recommendations(state: DataFrame, most: int = 6) -> DataFrame:
    """(place, text) of the advice that a state (see maturity()) gives, in order, ``most`` at most; wording of its own."""
    q = F.col("quality")
    rules = F.array(
        F.when(q < 50, "collect data in a better way"),
        F.when(F.col("topics") < 3, "cover more topics"),
        F.when(F.coalesce(F.col("share") < 0.5, F.lit(True)), "make the data easier to get"),
        F.when(~F.col("rated"), "rate the sentiment"),
        F.when(q >= 75, "publish").when(q >= 50, "refine the methods").otherwise("design the work anew"),
        F.when(q >= 75, "look for partners").when(q >= 50, "take a larger sample"),
    )
    return state.select(F.posexplode(F.slice(F.array_compact(rules), 1, most)).alias("place", "text")).select((F.col("place") + 1).alias("place"), "text")

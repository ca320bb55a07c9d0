"""Tables of numbers that panels show: summaries, fits and counts over topics, papers, phases and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.operators.topics import topic_quality


def spread(rows: DataFrame, value: str) -> list[Column]:
    """mean, median and population deviation of a column, to six digits."""
    return [F.round(f(value), 6).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]


def phase_times(phases: DataFrame) -> DataFrame:
    """phases: phase, seconds -> one row: phases, total, mean, median and population deviation of the phases' times."""
    each = phases.groupBy("phase").agg(F.sum("seconds").alias("seconds"))
    return each.agg(F.count("*").alias("phases"), F.round(F.sum("seconds"), 4).alias("total"), *[c for c in spread(each, "seconds")])


def normal_fit(topics: DataFrame) -> DataFrame:
    """One row: maximum likelihood mean and deviation of the topics' coherence, and its median. (No normality test.)"""
    c = topic_quality(topics)
    return c.agg(F.count("*").alias("topics"), F.round(F.avg("coherence"), 6).alias("mu"), F.round(F.stddev_pop("coherence"), 6).alias("sigma"), F.round(F.median("coherence"), 6).alias("median"))


def measures(*rows: tuple[str, DataFrame]) -> DataFrame:
    """(metric, value, std) of one-row tables with columns value and std."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), F.col("std").cast("double").alias("std")) for name, df in rows])


def summary_table(papers: DataFrame, rated: DataFrame, topics: DataFrame, phases: DataFrame) -> DataFrame:
    """(metric, value, std): papers, share with an abstract, mean topic coherence, polarity, time, share of phases that took any."""
    none = F.lit(0.0).alias("std")
    by_phase = phases.groupBy("phase").agg(F.sum("seconds").alias("s"))
    return measures(
        ("papers", papers.agg(F.count("*").alias("value"), none)),
        ("abstract_percent", papers.agg(F.round(F.avg(F.col("abstract").isNotNull().cast("double")) * 100, 4).alias("value"), none)),
        ("coherence", topic_quality(topics).agg(F.round(F.avg("coherence"), 4).alias("value"), F.round(F.stddev_pop("coherence"), 4).alias("std"))),
        ("polarity", rated.agg(F.round(F.avg("polarity"), 4).alias("value"), F.round(F.stddev_pop("polarity"), 4).alias("std"))),
        ("seconds", by_phase.agg(F.round(F.sum("s"), 4).alias("value"), F.round(F.stddev_pop("s"), 4).alias("std"))),
        ("phase_percent", by_phase.agg(F.round(F.avg((F.col("s") > 0).cast("double")) * 100, 4).alias("value"), none)),
    )


def conversion_rate(rows: DataFrame, done: Column) -> DataFrame:
    """One row: files, converted, rate (0 without files)."""
    return rows.agg(F.count("*").alias("files"), F.count_if(done).alias("converted"), F.round(F.coalesce(F.avg(done.cast("double")), F.lit(0.0)), 6).alias("rate"))


def entity_totals(entities: DataFrame, k: int = 10) -> DataFrame:
    """entities: kind, name -> per kind: occurrences, distinct names, and how many names a panel of the k most frequent shows."""
    return entities.groupBy("kind").agg(F.count("*").alias("total"), F.count_distinct("name").alias("names"), F.least(F.count_distinct("name"), F.lit(k)).alias("shown"))


def entity_coherence_pairs(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """(kind, n, coherence): the kinds' totals, in order of their names, beside the topics' coherences taken round and round. Both are short lists."""
    kinds = entities.groupBy("kind").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy("kind")) - 1)
    listed = topic_quality(topics).agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "coherence"))), lambda x: x["coherence"]).alias("c"))
    return kinds.join(F.broadcast(listed)).select("kind", "n", F.get("c", F.pmod("place", F.size("c")).cast("int")).alias("coherence"))


def topic_strengths(topics: DataFrame, first: int = 4, k: int = 10) -> DataFrame:
    """(topic, word, strength): a hundred times the weight of the k first words of the ``first`` topics by name."""
    best = topics.select("topic").distinct().orderBy("topic").limit(first)
    return topics.join(F.broadcast(best), ["topic"], "left_semi").where(F.col("rank") <= k).select("topic", "word", F.round(F.col("weight") * 100, 4).alias("strength"))


def complexity(topics: DataFrame, entities: DataFrame, vectors: DataFrame, rated: DataFrame) -> DataFrame:
    """(measure, n): different topics, entity kinds, clusters and sentiment labels."""
    counts = [("topics", topics, "topic"), ("entities", entities, "kind"), ("clusters", vectors, "label"), ("sentiments", rated, "label")]
    return reduce(DataFrame.unionByName, [df.agg(F.count_distinct(c).alias("n")).select(F.lit(name).alias("measure"), "n") for name, df, c in counts])


def nlp_panel(topics: DataFrame, rated: DataFrame, clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """(part, name, value): coherence of each topic, mean polarity, size of each cluster (-1 is Noise), distinct names shown of each entity kind."""
    parts = [
        topic_quality(topics).select(F.lit("coherence").alias("part"), F.col("topic").alias("name"), F.col("coherence").alias("value")),
        rated.agg(F.round(F.avg("polarity"), 6).alias("value")).select(F.lit("polarity").alias("part"), F.lit("mean").alias("name"), "value"),
        clusters.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("cluster").alias("part"), F.when(F.col("label") == -1, "Noise").otherwise(F.col("label").cast("string")).alias("name"), F.col("n").cast("double").alias("value")),
        entity_totals(entities).select(F.lit("entity").alias("part"), F.col("kind").alias("name"), F.col("shown").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def rag_panel(index_sizes: DataFrame, typed: DataFrame, answers: DataFrame) -> DataFrame:
    """(part, name, n): index sizes, questions of each type, and of each category of answers (category, error) how many came without an error."""
    parts = [
        index_sizes.select(F.lit("index").alias("part"), F.col("kind").alias("name"), "n"),
        typed.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("part"), F.col("type").alias("name"), "n"),
        answers.groupBy("category").agg(F.count_if(F.col("error").isNull()).alias("n")).select(F.lit("success").alias("part"), F.col("category").alias("name"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def one_page(phases: DataFrame, papers: DataFrame, rated: DataFrame, insights: DataFrame, first: int = 5) -> DataFrame:
    """(part, name, value as a string): time of each phase, corpus counts, percentages of the labels, the first insight questions."""
    n = papers.agg(F.count("*").alias("papers"), F.count("abstract").alias("abstracts"), F.count_distinct("journal").alias("journals"))
    total = rated.agg(F.count("*").alias("all"))
    parts = [
        phases.groupBy("phase").agg(F.round(F.sum("seconds"), 2).alias("v")).select(F.lit("phase").alias("part"), F.col("phase").alias("name"), F.format_string("%.2f", "v").alias("value")),
        n.unpivot([], n.columns, "name", "v").select(F.lit("count").alias("part"), "name", F.col("v").cast("string").alias("value")),
        rated.groupBy("label").agg(F.count("*").alias("k")).join(F.broadcast(total)).select(F.lit("sentiment").alias("part"), F.col("label").alias("name"), F.format_string("%.2f", F.col("k") * 100.0 / F.col("all")).alias("value")),
        insights.orderBy("category").limit(first).select(F.lit("insight").alias("part"), F.col("category").alias("name"), F.col("question").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def yearly_strength(dated: DataFrame) -> DataFrame:
    """dated: year, weight, polarity -> per year: papers, mean and deviation of the weight, mean polarity, and the fitted line of the counts."""
    by = dated.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("strength"), F.round(F.stddev_pop("weight"), 4).alias("band"), F.round(F.avg("polarity"), 6).alias("polarity"))
    line = by.agg(F.regr_slope("n", "year").alias("a"), F.regr_intercept("n", "year").alias("b"))
    return by.join(F.broadcast(line)).select("year", "n", "strength", "band", "polarity", F.round(F.col("a") * F.col("year") + F.col("b"), 4).alias("fitted"))

"""Lexicon sentiment, aspects, emotions and gap rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.functions import text as T

#: Own polarity lexicon: word -> from -1 to 1.
LEXICON = {
    "good": 0.7, "excellent": 1.0, "effective": 0.6, "successful": 0.75, "promising": 0.5, "best": 1.0, "better": 0.5, "new": 0.1, "great": 0.8, "significant": 0.4,
    "poor": -0.4, "failed": -0.5, "limited": -0.1, "difficult": -0.5, "challenging": -0.3, "bad": -0.7, "worthless": -0.9, "trash": -0.8, "disgusting": -1.0, "scum": -0.9,
}
# Emotion words, aspects, method words.
EMOTIONS = {
    "positive": ["good", "excellent", "effective", "successful", "promising"],
    "negative": ["poor", "failed", "limited", "difficult", "challenging"],
    "neutral": ["shown", "observed", "found", "reported", "described"],
}
ASPECTS = {
    "method": ["method", "approach", "technique", "procedure"],
    "result": ["result", "finding", "outcome", "effect"],
    "conclusion": ["conclusion", "summary", "implication"],
    "limitation": ["limitation", "constraint", "drawback"],
    "future work": ["future", "next", "further", "upcoming"],
}
METHOD_WORDS = ["method", "methodology", "approach", "technique", "algorithm"]


def _mean_weight(tokens: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    weights = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(v))])
    known = F.filter(F.transform(tokens, lambda t: F.element_at(weights, t)), lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), F.size(known)), F.lit(0.0))


def polarity(text: Column) -> Column:
    """Mean weight of the text's lexicon words, 0 without any. Only words that the lexicon can hold are looked up."""
    listed = F.filter(T.letter_words(text), lambda t: t.isin(list(LEXICON)))
    return _mean_weight(listed)


def subjectivity(text: Column) -> Column:
    """Mean strength (weight without its sign) of the text's lexicon words, from 0 to 1; 0 without any."""
    listed = F.filter(T.letter_words(text), lambda t: t.isin(list(LEXICON)))
    return _mean_weight(listed, {w: abs(p) for w, p in LEXICON.items()})


def label(p: Column) -> Column:
    return F.when(p > 0.1, "positive").when(p < -0.1, "negative").otherwise("neutral")


def sentiment(papers: DataFrame) -> DataFrame:
    p = polarity(F.col("abstract"))
    return papers.select("doc_id", F.round(p, 6).alias("polarity")).withColumn("label", label(F.col("polarity")))


def overall(rated: DataFrame) -> DataFrame:
    """One row: mean and population deviation, shares, the positive share's 95 % half-width in percent, entropy and stability of the labels."""
    shares = {x: F.avg((F.col("label") == x).cast("double")) for x in ("positive", "negative", "neutral")}
    one = rated.agg(F.count("*").alias("n"), F.round(F.avg("polarity"), 6).alias("mean"), F.round(F.stddev_pop("polarity"), 6).alias("std"), *[c.alias(k) for k, c in shares.items()])
    entropy = -sum((F.col(k) * F.log2(F.col(k) + 1e-10) for k in shares), F.lit(0.0))
    return one.select("n", "mean", "std", *[F.round(k, 6).alias(k) for k in shares], F.round(1.96 * F.sqrt(F.try_divide(F.col("positive") * (1 - F.col("positive")), "n")) * 100, 6).alias("half_width"), F.round(entropy, 6).alias("entropy"), F.round(1 - entropy / F.log2(F.lit(3.0)), 6).alias("stability"))


def aspects(papers: DataFrame) -> DataFrame:
    """(aspect, n_texts, n_sentences, mean): sentences (by full stops) that hold a word of the aspect, and the polarity of a text's joined ones."""
    parts = F.split(F.coalesce("abstract", F.lit("")), r"\.")

    def own(words: list[str]) -> Column:
        return F.filter(parts, lambda s: F.lower(s).rlike("|".join(words)))

    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), own(w).alias("s")) for a, w in ASPECTS.items()]))
    found = papers.select(rows.alias("r")).where(F.size("r.s") > 0).select("r.aspect", F.size("r.s").alias("k"), polarity(F.array_join("r.s", ".")).alias("p"))
    return found.groupBy("aspect").agg(F.count("*").alias("n_texts"), F.sum("k").alias("n_sentences"), F.round(F.avg("p"), 6).alias("mean"))


def emotion_counts(papers: DataFrame) -> DataFrame:
    """(emotion, word, n) over all abstracts, surface forms."""
    words = [w for ws in EMOTIONS.values() for w in ws]
    emotion = F.create_map(*[x for e, ws in EMOTIONS.items() for w in ws for x in (F.lit(w), F.lit(e))])
    found = papers.select(F.explode(F.filter(T.letter_words(F.col("abstract")), lambda t: t.isin(words))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.select(F.element_at(emotion, F.col("word")).alias("emotion"), "word", "n")


def method_gap(papers: DataFrame, least: float = 0.3) -> DataFrame:
    """One row: how often a text holds a method word (several count), that per text, and whether it is a gap."""
    low = F.lower(F.coalesce("abstract", F.lit("")))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in METHOD_WORDS), F.lit(0))
    one = papers.agg(F.sum(hits).alias("hits"), F.count("*").alias("texts"))
    return one.select("hits", "texts", F.round(F.coalesce(F.try_divide("hits", "texts"), F.lit(0.0)), 6).alias("share"), (F.coalesce(F.try_divide("hits", "texts"), F.lit(0.0)) < least).alias("gap"))

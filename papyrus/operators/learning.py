"""Topics and clusters by pyspark.ml; their exact parts as joins and aggregates."""

from __future__ import annotations

import math

from pyspark.ml.clustering import LDA, KMeans, LDAModel
from pyspark.ml.feature import IDF, PCA, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T


#: Passes of the online fit; each sees SHARE of the papers, so together they see every paper about ten times.
TOPICS, ITERATIONS, SHARE, LEAST_TEXTS = 10, 100, 0.1, 5


def _weighted(papers: DataFrame, vocabulary: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, features): tf-idf of the papers' words; and the vocabulary."""
    docs = papers.select("doc_id", F.filter(T.letter_words(F.col("abstract")), lambda t: ~t.isin(T.ABSTRACT_STOPS)).alias("words")).where(F.size("words") > 0)
    if docs.limit(LEAST_TEXTS).count() < LEAST_TEXTS:
        raise ValueError(f"topics need {LEAST_TEXTS} texts at least")
    counter = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary, minDF=2, maxDF=0.8).fit(docs)
    counted = counter.transform(docs)
    return IDF(inputCol="tf", outputCol="features", minDocFreq=2).fit(counted).transform(counted).select("doc_id", "features"), counter.vocabulary


def _lda(weighted: DataFrame, topics: int, iterations: int) -> LDAModel:
    return LDA(k=topics, maxIter=iterations, optimizer="online", subsamplingRate=SHARE, learningDecay=0.7, learningOffset=50.0, seed=42).fit(weighted)


def lda_topics(papers: DataFrame, topics: int = TOPICS, iterations: int = ITERATIONS, vocabulary: int = 1000) -> DataFrame:
    """(topic, rank, term, weight, coherence): the ten words of highest weight of each topic; coherence is the mean of the first five weights."""
    weighted, words = _weighted(papers, vocabulary)
    weighted = weighted.persist()
    model = _lda(weighted, topics, iterations)
    weighted.unpersist()
    named = F.array(*[F.lit(w) for w in words])
    flat = model.describeTopics(10).select("topic", (F.aggregate(F.slice("termWeights", 1, 5), F.lit(0.0), lambda a, b: a + b) / 5).alias("coherence"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"))
    return flat.select("topic", (F.col("pos") + 1).alias("rank"), F.get(named, F.col("t.termIndices")).alias("term"), F.round("t.termWeights", 6).alias("weight"), F.round("coherence", 6).alias("coherence"))


def lda_perplexity(papers: DataFrame, counts: tuple[int, ...] = (5, 10), iterations: int = 20, vocabulary: int = 1000) -> DataFrame:
    """(topics, perplexity): the exponential of the bound on a token's negative log likelihood, for each number of topics. One number each reaches the driver."""
    weighted, _ = _weighted(papers, vocabulary)
    weighted = weighted.persist()
    rows = [(k, math.exp(_lda(weighted, k, iterations).logPerplexity(weighted))) for k in counts]
    weighted.unpersist()
    return papers.sparkSession.createDataFrame(rows, "topics int, perplexity double")


def elbow(costs: list[tuple[int, float]]) -> int:
    """First k whose improvement is under half of the mean one, else min(5, largest k)."""
    steps = [a[1] - b[1] for a, b in zip(costs, costs[1:], strict=False)]
    mean = sum(steps) / len(steps) if steps else 0.0
    return next((k for (k, _), s in zip(costs, steps, strict=False) if s < 0.5 * mean), min(5, costs[-1][0]))


def kmeans_clusters(vectors: DataFrame, most: int = 10, dimensions: int = 50) -> DataFrame:
    """vectors: id, v -> (cluster, size, k) with k by the elbow rule over 2..min(most, n/2) (one number for each k reaches the driver).

    Vectors of more than ``dimensions`` components are first projected to that many principal ones.
    """
    data = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    wide = vectors.select(F.size("v").alias("n")).first()
    if wide and wide["n"] > dimensions:
        data = PCA(k=dimensions, inputCol="features", outputCol="p").fit(data).transform(data).select("id", F.col("p").alias("features"))
    data = data.persist()
    top = max(2, min(most, data.count() // 2))
    models = {k: KMeans(k=k, seed=42, maxIter=10).fit(data) for k in range(2, top + 1)}
    k = elbow([(k, m.summary.trainingCost) for k, m in models.items()])
    data.unpersist()
    return models[k].transform(data).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("size")).withColumn("k", F.lit(k))


def centroid_silhouette(vectors: DataFrame) -> DataFrame:
    """vectors: id, v, label -> one row: mean simplified silhouette with squared distances to the labels' centroids.

    A label's centroid is one row; a point meets the centroids, not the other points.
    """
    flat = vectors.select("label", F.posexplode(F.col("v").cast("array<double>")).alias("d", "x"))
    means = flat.groupBy("label", "d").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "other")
    dist = F.aggregate(F.zip_with(F.col("v").cast("array<double>"), "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    each = vectors.join(F.broadcast(centroids)).select("id", "label", "other", dist.alias("d"))  # as many centroids as labels
    one = each.groupBy("id", "label").agg(F.min(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return one.agg(F.count("*").alias("n"), F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"))


def cluster_sizes(vectors: DataFrame) -> DataFrame:
    """One row: clusters, mean and population deviation of their sizes, coefficient of variation."""
    s = vectors.groupBy("label").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_pop("n"), 4).alias("std"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("variation"))


def cluster_summaries(papers: DataFrame, group: str, k: int = 10) -> DataFrame:
    """(group, size, words, example): the k most frequent words of over 3 letters and the start of the first text of each group."""
    words = papers.select(group, F.explode(T.letter_words(F.col("abstract"), 4)).alias("w")).groupBy(group, "w").agg(F.count("*").alias("n"))
    best = words.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "w"))).where(F.col("rank") <= k)
    listed = best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), " ").alias("words"))
    sizes = papers.groupBy(group).agg(F.count("*").alias("size"), F.min_by(F.substring("abstract", 1, 200), "doc_id").alias("example"))
    return sizes.join(listed, [group], "left")


def dominant_label(vectors: DataFrame) -> DataFrame:
    """(id, dim, value): the (first) largest component of each vector."""
    v = F.col("v").cast("array<double>")
    return vectors.select("id", (F.array_position(v, F.array_max(v)) - 1).alias("dim"), F.round(F.array_max(v), 6).alias("value"))


def to_array(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, vector_to_array(F.col(col)))

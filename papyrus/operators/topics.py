"""Tables of topics (group, rank, word, weight): shared words, links to entities, statistics; density clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.operators.graph import label_components
from papyrus.operators.similarity import block_pairs, inner, unit


def word_pairs(topics: DataFrame, per_topic: int = 5, top_words: int = 15) -> DataFrame:
    """(a, b, n): words that are among the first ``per_topic`` of more than one topic together, both among the ``top_words`` most frequent ones."""
    first = topics.where(F.col("rank") <= per_topic)
    best = first.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(top_words).select("word")
    kept = first.join(F.broadcast(best), ["word"], "left_semi").select("topic", "word")
    pairs = kept.select("topic", F.col("word").alias("a")).join(kept.select("topic", F.col("word").alias("b")), ["topic"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")


def entity_links(topics: DataFrame, entities: DataFrame, most: int = 1000) -> DataFrame:
    """(topic, entity, weight): how many of a topic's words stand within an entity's name. entities: entity, at most ``most`` rows (checked)."""
    if entities.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entities")
    hit = F.contains(F.lower("entity"), F.col("word"))
    return topics.join(F.broadcast(entities), hit).groupBy("topic", "entity").agg(F.count("*").alias("weight"))


def positional_links(topics: DataFrame, entities: DataFrame) -> DataFrame:
    """(topic, entity): the topic at place i gets the entities at places 2i and 2i + 1 (places by name; both tables are short lists)."""
    t = topics.select("topic").distinct().withColumn("place", F.row_number().over(Window.orderBy("topic")) - 1)
    e = entities.select("entity", F.floor((F.row_number().over(Window.orderBy("entity")) - 1) / 2).alias("place"))
    return t.join(F.broadcast(e), ["place"]).select("topic", "entity")


def word_statistics(topics: DataFrame, k: int = 10) -> DataFrame:
    """(word, n, mean, std): the k words of highest mean weight over topics, with the sample deviation (null for one topic)."""
    s = topics.groupBy("word").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean"), F.round(F.stddev_samp("weight"), 4).alias("std"))
    return s.orderBy(F.col("mean").desc(), "word").limit(k)


def topic_quality(topics: DataFrame) -> DataFrame:
    """(topic, coherence, variety, mean, std): mean weight of the first five words, distinct words over ten, mean and deviation of the weights."""
    return topics.groupBy("topic").agg(
        F.round(F.avg(F.when(F.col("rank") <= 5, F.col("weight"))), 4).alias("coherence"), F.round(F.count_distinct("word") / 10, 4).alias("variety"),
        F.round(F.avg("weight"), 4).alias("mean"), F.round(F.stddev_pop("weight"), 4).alias("std"),
    )


def weakest(topics: DataFrame, k: int = 3) -> DataFrame:
    return topic_quality(topics).select("topic", "coherence").orderBy("coherence", "topic").limit(k)


def length_weight_bins(topics: DataFrame, bins: int = 10) -> DataFrame:
    """(length, bin, n): word lengths against weights in ``bins`` equal bins up to the largest weight."""
    top = topics.agg(F.max("weight").alias("most"))
    place = F.least(F.floor(F.col("weight") * bins / F.col("most")), F.lit(bins - 1)).cast("int")
    return topics.join(F.broadcast(top)).groupBy(F.length("word").alias("length"), place.alias("bin")).agg(F.count("*").alias("n"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, to nine digits; the difference is taken before squares, a few rows at a time."""
    out, step = np.empty((len(x), len(y))), max(1, (1 << 15) // max(1, len(y)))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.sqrt(((x[lo : lo + step, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out.round(9)


def _nearest(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    d = _distances(np.stack(left["v"].to_list()), np.stack(right["v"].to_list())) if len(left) and len(right) else np.zeros((0, 0))
    if same:
        np.fill_diagonal(d, np.inf)
    sides = [(left["id"], d.min(axis=1))] + ([] if same else [(right["id"], d.min(axis=0))]) if d.size else []
    return pd.concat([pd.DataFrame({"id": i, "d": m}) for i, m in sides]) if sides else pd.DataFrame({"id": [], "d": []})


def density_clusters(vectors: DataFrame, quantile: float = 0.95) -> DataFrame:
    """vectors: id, v -> (id, cluster): density clusters with two points at least; -1 for noise.

    With two points enough for a core, clusters are the components of the pairs at most eps apart; eps is the 95th
    percentile of the distances to the nearest neighbour. Blocks of vectors meet in numpy, once for the nearest distance
    of each and once for the pairs within eps; one number a vector and block leaves the first, only links the second.
    """
    value = F.col("v").cast("array<double>")
    near = block_pairs(vectors, "id", value, "id long, d double", _nearest, combine=lambda rows: rows.groupby("id", as_index=False)["d"].min()).groupBy("id").agg(F.min("d").alias("d"))
    eps = near.where("d < double('infinity')").agg(F.percentile("d", quantile)).first()[0]

    def within(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if eps is None or not (len(left) and len(right)):
            return pd.DataFrame({"src": [], "dst": []})
        i, j = np.nonzero(_distances(np.stack(left["v"].to_list()), np.stack(right["v"].to_list())) <= eps)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = (a < b) if same else (a != b)
        return pd.DataFrame({"src": np.minimum(a, b)[keep], "dst": np.maximum(a, b)[keep]})

    found = label_components(block_pairs(vectors, "id", value, "src long, dst long", within))
    return vectors.select("id").join(found.toDF("id", "cluster"), ["id"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def silhouettes(vectors: DataFrame) -> DataFrame:
    """vectors: id, label, v -> (label, n, silhouette): mean over a label's vectors of (b - a) / max(a, b), a being the mean distance to the others of the label, b the least mean distance to another label; 0 for a vector without either.

    Blocks of vectors meet in numpy; a task gives one sum for each of its vectors and label of all the blocks that it compares.
    """

    def sums(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = []
        for x, y in ((left, right),) if same else ((left, right), (right, left)):
            if len(x) and len(y):
                d, labels = _distances(np.stack([v["v"] for v in x["v"]]), np.stack([v["v"] for v in y["v"]])), np.array([v["label"] for v in y["v"]])
                for label in np.unique(labels):
                    there = labels == label
                    own = np.array([v["label"] == label for v in x["v"]]) & same  # a vector itself is not among its label's others
                    out.append(pd.DataFrame({"id": x["id"], "label": [v["label"] for v in x["v"]], "other": label, "s": d[:, there].sum(axis=1), "n": there.sum() - own}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "label": [], "other": [], "s": [], "n": []})

    value = F.struct("label", F.col("v").cast("array<double>").alias("v"))
    each = block_pairs(vectors, "id", value, "id long, label long, other long, s double, n long", sums, combine=lambda rows: rows.groupby(["id", "label", "other"], as_index=False)[["s", "n"]].sum()).groupBy("id", "label", "other").agg((F.try_divide(F.sum("s"), F.sum("n"))).alias("d"))
    one = each.groupBy("id", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return one.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))), 6).alias("silhouette"))


def label_similarity(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) between the mean vectors of labels (few rows)."""
    flat = vectors.select("label", F.posexplode(F.col("v").cast("array<double>")).alias("d", "x"))
    means = flat.groupBy("label", "d").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    a, b = means.select(F.col("label").alias("a"), unit(F.col("m")).alias("x")), means.select(F.col("label").alias("b"), unit(F.col("m")).alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(inner(F.col("x"), F.col("y")), 6).alias("cosine"))


def coherence_sentiment(topics: DataFrame, rated: DataFrame) -> DataFrame:
    """One row: slope and correlation of topics' coherence against the mean polarity of their papers (null where either is constant). rated: topic, polarity."""
    c = topics.where("rank <= 5").groupBy("topic").agg(F.avg("weight").alias("c"))
    p = rated.groupBy("topic").agg(F.avg("polarity").alias("p"))
    both = c.join(p, ["topic"])
    return both.agg(F.count("*").alias("topics"), F.round(F.try_divide(F.covar_pop("c", "p"), F.var_pop("p")), 4).alias("slope"), F.round(F.try_divide(F.covar_pop("c", "p"), F.stddev_pop("c") * F.stddev_pop("p")), 4).alias("r"))

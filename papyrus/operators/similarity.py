"""Set similarity, exact, by prefix-filtered inverted indexes or, for low thresholds, block by block; exact inner products."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T
from papyrus.operators.graph import checkpointed


def term_sets(papers: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, terms): the distinct words of an abstract."""
    return papers.select("doc_id", F.array_distinct(T.letter_words(F.col("abstract"), least)).alias("terms"))


#: Rows of a block, by what a task can hold: two blocks at a time. A smaller table is cut into SPREAD blocks, but none under LEAST_ROWS.
BLOCK_ROWS, LEAST_ROWS, SPREAD = 4096, 512, 16
#: Partitions of the blocks: as many times themselves are tasks. Right rows that are compared at once, terms that are counted by a product.
MOST_PARTITIONS, STRIP, DENSE = 128, 512, 4096
#: Partitions where a task's rows are combined, and rows that are combined at once.
COMBINED, COMBINED_ROWS = 12, 1_000_000
#: Queries and vectors of a block, and how far below the k-th score a vector is still looked at.
QUERY_ROWS, VECTOR_ROWS, MARGIN = 1024, 32768, 2e-6
#: Thresholds from which prefixes are short enough to prune.
PREFIX_FROM = 0.6


def jaccard_pairs(sets: DataFrame, over: float = 0.05) -> DataFrame:
    """(a, b, shared, total, jaccard) of all pairs a < b of sets (doc_id, terms) whose similarity exceeds ``over`` (from 0 to 1); shared and total count the terms of both and of either.

    Equal sets are one class: a class's members are linked to its first, and only first members are compared with each
    other. The result holds class representatives; see class_members(). High thresholds go through an index of prefixes. Under
    PREFIX_FROM a prefix is most of a set and prunes nothing: the sets are compared block by block, terms as 64-bit hashes.
    """
    classes = _classes(sets)
    return _pairs_by_prefix(classes, over) if over >= PREFIX_FROM else _pairs_by_blocks(classes, over)


def _pairs_by_prefix(classes: DataFrame, over: float) -> DataFrame:
    """Terms are ordered from rare to frequent; a pair can only pass if the first few terms of both (their prefixes) share one, so frequent terms are never joined on."""
    exploded = classes.select("rep", F.explode("terms").alias("term"))
    frequency = exploded.groupBy("term").agg(F.count("*").alias("df"))
    key = F.xxhash64("term")
    ordered = exploded.join(frequency, ["term"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", key.alias("term")))).alias("o")).select("rep", F.transform("o", lambda x: x["term"]).alias("terms"), F.size("o").alias("n"))
    prefix = F.slice("terms", 1, F.col("n") - F.ceil(F.col("n") * F.lit(over)).cast("int") + 1)
    index = ordered.select(F.col("rep").alias("id"), "n", F.posexplode(prefix).alias("pos", "term"))
    left, right = (index.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), "term") for x in ("a", "b"))
    # The smaller set must be larger than ``over`` times the larger; what can still be shared from these positions on must suffice.
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") > F.lit(over) * F.greatest("na", "nb"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    near &= rest >= F.lit(over / (1 + over)) * (F.col("na") + F.col("nb"))
    candidates = left.join(right, ["term"]).where(near).groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")
    both = candidates.join(ordered.select(F.col("rep").alias("a"), F.col("terms").alias("x")), ["a"]).join(ordered.select(F.col("rep").alias("b"), F.col("terms").alias("y")), ["b"])
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("n"))
    return shared.select("a", "b", "shared", (F.col("n") - F.col("shared")).alias("total")).withColumn("jaccard", F.col("shared") / F.col("total")).where(F.col("jaccard") > over)


def block_pairs(rows: DataFrame, key: str, value: Column, schema: str, compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], block_rows: int = BLOCK_ROWS, *, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Every block of rows (key: a long, value) meets every block once, itself included: compare(left, right, same) -> schema.

    Blocks are dealt by hash and as many as the rows need, and each is written once to the shared folder, as one row. A task reads the
    blocks that it compares from there (a product of partitions, which shuffles nothing), so it holds a few blocks whatever the keys are, and
    the disk holds the rows once however many blocks there are; the work is that of all pairs, which low thresholds ask for, and what
    leaves a task is only what compare() keeps. Where ``combine`` sums up rows of compare(), there are fewer tasks of more blocks each, and
    each combines all of its rows, so that a row leaves at most twice for each of COMBINED partitions, not for each block.
    """
    own = rows.select(F.col(key).alias("id"), value.alias("v"))
    count = own.count()
    n = max(1, -(-count // block_rows), min(SPREAD, -(-count // min(LEAST_ROWS, block_rows))))
    dealt = own.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blk": [block["blk"].iloc[0]], "rows": [pickle.dumps(block[["id", "v"]], pickle.HIGHEST_PROTOCOL)]})

    blocks = checkpointed(dealt.repartition(min(n, COMBINED if combine else MOST_PARTITIONS), "blk").groupBy("blk").applyInPandas(packed, "blk int, rows binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, found, many = None, None, [], 0
        for batch in batches:
            for lo, hi, x, y in zip(batch["lo"], batch["hi"], batch["x"], batch["y"], strict=True):
                if at != lo:
                    at, left = lo, pickle.loads(x)
                found.append(compare(left, left if lo == hi else pickle.loads(y), lo == hi))
                many += len(found[-1])
                if combine and many >= COMBINED_ROWS and len(found) > 1:
                    found = [combine(pd.concat(found))]
                    many = len(found[0])
                if not combine or many >= COMBINED_ROWS:  # the second: nothing more to be combined
                    yield from found
                    found, many = [], 0
        if found:
            yield combine(pd.concat(found))

    right = blocks.select(F.col("blk").alias("hi"), F.col("rows").alias("y")).hint("shuffle_replicate_nl")
    return blocks.select(F.col("blk").alias("lo"), F.col("rows").alias("x")).join(right, F.col("lo") <= F.col("hi")).mapInPandas(run, schema)


def _incidence(rows: np.ndarray, at: np.ndarray, n: int, terms: int) -> np.ndarray:
    out = np.zeros((n, terms), np.float32)
    out[rows, at] = 1
    return out


def shared_terms(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first right row, counts): how many terms each left set shares with each of some right ones, STRIP of them at a time.

    The DENSE terms that most pairs share are counted by a product of matrices, the others by their pairs.
    """
    sides = [(np.concatenate([np.zeros(0, np.int64), *x]), np.repeat(np.arange(len(x)), [len(t) for t in x])) for x in (left, right)]
    terms = np.intersect1d(sides[0][0], sides[1][0])
    if not len(terms):
        yield from ((lo, np.zeros((len(left), min(STRIP, len(right) - lo)), np.int64)) for lo in range(0, len(right), STRIP))
        return
    found = []
    for flat, rows in sides:
        at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
        there = terms[at] == flat
        found.append((rows[there], at[there]))
    (lrows, lat), (rrows, rat) = found
    many = np.bincount(lat, minlength=len(terms))
    order = np.argsort(-many * np.bincount(rat, minlength=len(terms)), kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    lat, rat, d = place[lat], place[rat], min(DENSE, len(terms))
    dense = _incidence(lrows[lat < d], lat[lat < d], len(left), d)
    rare = lat >= d
    by_term = np.argsort(lat[rare], kind="stable")
    posted, first = lrows[rare][by_term], np.searchsorted(lat[rare][by_term], np.arange(d, len(terms) + 1))
    for lo in range(0, len(right), STRIP):
        hi = min(len(right), lo + STRIP)
        a, b = np.searchsorted(rrows, [lo, hi])
        rows, at = rrows[a:b] - lo, rat[a:b]
        counts = (dense @ _incidence(rows[at < d], at[at < d], hi - lo, d).T).astype(np.int64)
        rows, at = rows[at >= d], at[at >= d] - d
        n = first[at + 1] - first[at]
        if n.sum():
            where = np.arange(int(n.sum())) + np.repeat(first[at] - (np.cumsum(n) - n), n)
            counts += np.bincount(posted[where] * (hi - lo) + np.repeat(rows, n), minlength=counts.size).reshape(counts.shape)
        yield lo, counts


def _pairs_by_blocks(classes: DataFrame, over: float) -> DataFrame:
    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        n, m = (np.array([len(t) for t in x["v"]], np.int64) for x in (left, right))
        out = [np.zeros((4, 0), np.int64)]
        for lo, shared in shared_terms(list(left["v"]), list(right["v"])):
            total = n[:, None] + m[None, lo : lo + shared.shape[1]] - shared
            i, j = np.nonzero(shared / total > over)
            x, y = a[i], b[j + lo]
            keep = (x < y) if same else (x != y)
            out.append(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep], shared[i, j][keep], total[i, j][keep]]))
        return pd.DataFrame(dict(zip(("a", "b", "shared", "total"), np.concatenate(out, axis=1), strict=True)))

    found = block_pairs(classes, "rep", F.transform("terms", lambda t: F.xxhash64(t)), "a long, b long, shared long, total long", compare)
    return found.withColumn("jaccard", F.col("shared") / F.col("total"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """(row, col, jaccard): the matrix of pairs a < b, both halves without the diagonal."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("col")), F.struct(F.col("b").alias("row"), F.col("a").alias("col")))).alias("at"), "jaccard").select("at.row", "at.col", "jaccard")


def _classes(sets: DataFrame) -> DataFrame:
    """(rep, terms) of the distinct non-empty sets; rep is the smallest doc_id. Sets are told apart by a digest, so no array is a key."""
    key = F.sha2(F.array_join(F.array_sort("terms"), " "), 256)
    return sets.where(F.size("terms") > 0).groupBy(key.alias("key")).agg(F.min_by(F.struct("doc_id", "terms"), "doc_id").alias("c")).select(F.col("c.doc_id").alias("rep"), "c.terms")


def class_members(sets: DataFrame) -> DataFrame:
    """(doc_id, rep) of every non-empty set; a class, however large, is summed up before the shuffle and joined back."""
    keyed = sets.where(F.size("terms") > 0).select("doc_id", F.sha2(F.array_join(F.array_sort("terms"), " "), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("rep")), ["key"]).select("doc_id", "rep")


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared, F.size(x) + F.size(y) - shared), F.lit(0.0))


def group_jaccard(groups: DataFrame) -> DataFrame:
    """(a, b, jaccard) over all pairs of groups (name, terms) a < b that share a term, by an inverted index."""
    sizes = groups.select("name", F.size("terms").alias("n"))
    index = groups.select("name", F.explode("terms").alias("term"))
    left, right = index.withColumnRenamed("name", "a"), index.withColumnRenamed("name", "b")
    shared = left.join(right, ["term"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    named = shared.join(sizes.toDF("a", "na"), ["a"]).join(sizes.toDF("b", "nb"), ["b"])
    return named.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def unit(vector: Column) -> Column:
    """The vector in doubles at length one (unchanged if its length is 0)."""
    x = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(x)


def inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of highest cosine to each query, within each kind. queries: query_id, q. vectors: id, kind, v.

    A stated query set meets every vector: blocks of queries are written once and meet the partitions of vectors as a product, in which nothing
    is shuffled. A product of matrices finds, for each query and kind, the vectors that can be among a task's first k; their scores are then
    summed as inner() does, dimension by dimension. What leaves a task follows the queries, not the vectors.
    """
    asked = queries.select("query_id", unit(F.col("q")).alias("q")).where(F.col("q").isNotNull())
    own = vectors.select("id", "kind", unit(F.col("v")).alias("v")).where(F.col("v").isNotNull())
    counts = [df.count() for df in (asked, own)]
    many = [max(1, min(MOST_PARTITIONS, -(-n // rows)), min(SPREAD, -(-n // LEAST_ROWS)) if spread else 1) for n, rows, spread in zip(counts, (QUERY_ROWS, VECTOR_ROWS), (False, True), strict=True)]

    def packed(part: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
        """Blocks of ``most`` rows or so, in one cell each."""
        held, n = [], 0
        for batch in part:
            held.append(batch)
            n += len(batch)
            if n >= most:
                yield pd.DataFrame({"rows": [pickle.dumps(pd.concat(held), pickle.HIGHEST_PROTOCOL)]})
                held, n = [], 0
        if n:
            yield pd.DataFrame({"rows": [pickle.dumps(pd.concat(held), pickle.HIGHEST_PROTOCOL)]})

    left = checkpointed(own.repartition(many[1], "id").mapInPandas(lambda part: packed(part, VECTOR_ROWS), "rows binary"))
    right = checkpointed(asked.repartition(many[0], "query_id").mapInPandas(lambda part: packed(part, QUERY_ROWS), "rows binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block = None, None
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                if last is None or x != last:
                    last, block = x, pickle.loads(x)
                yield from _best(pickle.loads(y), block, k)

    met = left.toDF("x").join(right.toDF("y").hint("shuffle_replicate_nl"))
    kind = vectors.schema["kind"].dataType.simpleString()
    ids = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "id"))]
    found = met.mapInPandas(run, f"query_id {ids[0]}, kind {kind}, id {ids[1]}, s double")
    # Without a vector there is no score: of those the first k of each kind come after all others.
    first = Window.partitionBy("kind").orderBy("id")
    few, none = (df.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("kind", "id", F.lit(None).cast("double").alias("s")) for df in (vectors, vectors.where(F.col("v").isNull())))
    found = found.unionByName(queries.where(F.col("q").isNotNull()).select("query_id").join(none)).unionByName(queries.where(F.col("q").isNull()).select("query_id").join(few))
    scored = found.select("query_id", "kind", "id", F.round("s", 6).alias("score"))
    w = Window.partitionBy("query_id", "kind").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """(query_id, kind, id, s) of all vectors of each kind whose score, rounded, may be among the first k of a query."""
    asked, ids = np.stack(queries["q"].to_list()), queries["query_id"].to_numpy()
    for kind, own in vectors.groupby("kind", dropna=False):
        x = np.stack(own["v"].to_list())
        near = asked @ x.T
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(asked), -np.inf)
        # Half a step of rounding on both sides, and what sums in another order may differ by.
        i, j = np.nonzero(near >= (least - MARGIN)[:, None])
        s = np.zeros(len(i))
        for d in range(x.shape[1]):
            s = s + asked[i, d] * x[j, d]
        if len(i) > k * len(asked):  # of many equal scores those of the least ids
            steps = s * 1e6
            rough = pd.DataFrame({"i": i, "r": -np.round(steps), "id": own["id"].to_numpy()[j], "between": np.abs(steps - np.floor(steps) - 0.5) < 1e-3}).sort_values(["i", "r", "id"], kind="stable")
            kth = rough["i"].map(rough[rough.groupby("i").cumcount() == k - 1].set_index("i")["r"])
            # A score between two steps may be rounded otherwise by Spark: it is kept, and so is one step below the k-th.
            keep = rough.index[kth.isna() | (rough["r"] <= kth + 1) & (rough["between"] | (rough.groupby(["i", "r"]).cumcount() < k))].to_numpy()
            i, j, s = i[keep], j[keep], s[keep]
        yield pd.DataFrame({"query_id": ids[i], "kind": [kind] * len(i), "id": own["id"].to_numpy()[j], "s": s})

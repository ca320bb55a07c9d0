"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

The words and symbol runs of a text, lower-cased, give one unigram and one bigram each (the last one's bigram is with the
text's end); each n-gram is hashed to one of ``buckets`` numbers. Two multinomials with add-one smoothing are counted over
the buckets: one over every document (raw), one over trusted documents (target). A document's score is the mean over its
n-grams of log p_target - log p_raw, and every document whose score is below ``threshold`` is rejected: the same text gets
the same verdict in every run. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKETS = 10_000
#: At most this many trusted documents (those with the smallest hashes of their ids) make the target; the raw side counts all.
MAX_TRUSTED = 20_000
#: Nats for each n-gram. Clean text scores about zero or above; see the README for the measured margin.
THRESHOLD = -0.25


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id of labelled rows of good quality that are not toxic, at most max_trusted of them."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def _grams(text: Column, buckets: int) -> tuple[Column, Column]:
    """Hashes of the tokens, and from such hashes the buckets of unigrams and bigrams."""
    hashes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    own = F.col("hashes")
    pairs = F.transform(own, lambda h, i: F.pmod(F.xxhash64(h, F.get(own, i + 1)), F.lit(buckets)))
    return hashes, F.concat(F.transform(own, lambda h: F.pmod(h, F.lit(buckets))), pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array with each bucket's log p_target - log p_raw; all zeros where nothing is trusted.

    docs: doc_id, text. trusted: doc_id, bounded (see MAX_TRUSTED), so it is broadcast. The counts are summed on the map
    side: what is shuffled is at most ``buckets`` rows from each task.
    """
    hashes, grams = _grams(F.col("text"), buckets)
    marked = docs.join(F.broadcast(trusted.withColumn("target", F.lit(1))), ["doc_id"], "left").select("target", hashes.alias("hashes"))
    counts = marked.select("target", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    full = all_buckets.join(counts, ["bucket"], "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))

    def ratio(c: Column) -> Column:
        return F.log((c["target"] + 1) / (F.col("n_target") + buckets)) - F.log((c["raw"] + 1) / (F.col("n_raw") + buckets))

    return listed.select(F.transform("c", lambda c: F.when(F.col("n_target") > 0, ratio(c)).otherwise(F.lit(0.0))).alias("ratios"))


def _repeat_words(hashes: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """Steps to the number of words in 3-word windows that occur twice or more; each step reads the ones before by name (words too).

    A window's 64-bit hash gives its low bits to the position (as many as the text needs) and is sorted, so equal windows
    are neighbours: n log n for any text. Windows without such a neighbour occur once. The others, few in most texts, are
    sorted by their words, so no two different ones count as equal.
    """
    n, own = F.size(hashes), hashes
    mask = F.expr("shiftleft(1L, length(bin(size(hashes)))) - 1L")
    windows = F.transform(own, lambda h, i: F.xxhash64(h, F.get(own, i + 1), F.get(own, i + 2)).bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long")))
    ordered = F.sort_array(F.when(n >= 3, F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    s, m, w = F.col("ordered"), F.bitwise_not(F.col("mask")), F.col("words")
    alike = F.filter(s, lambda x, i: (x.bitwiseAND(m) == F.get(s, i + 1).bitwiseAND(m)) | (x.bitwiseAND(m) == F.get(s, i - 1).bitwiseAND(m)))
    at = F.transform(alike, lambda x: x.bitwiseAND(F.col("mask")).cast("int"))
    spelt = F.sort_array(F.transform(F.col("alike"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("w"), p.alias("p"))))
    e = F.col("spelt")
    twice = F.filter(e, lambda x, i: (x["w"] == F.get(e, i + 1)["w"]) | (x["w"] == F.get(e, i - 1)["w"]))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return mask, ordered, at, spelt, places, covered


def assess(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text and the columns of carry) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null texts count as empty; a text without tokens scores 0. Words are maximal runs without \\x20 and \\x09-\\x0D. The
    base rules fail a text of fewer than 50 words, or with more than half of its words in repeated 3-word windows.
    """
    keep = [F.col(f"`{c}`") for c in carry]
    text = F.coalesce("text", F.lit(""))
    hashes, grams = _grams(F.col("text"), buckets)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    step = docs.select(
        "doc_id", *keep,
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        hashes.alias("gram_hashes"),
    )
    counted = ["doc_id", *keep, "word_chars", "n_symbols", "n_dup_lines"]
    mask, ordered, alike, spelt, places, covered = _repeat_words(F.col("hashes"))
    step = step.select(*counted, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "gram_hashes")
    step = step.select(*counted, "words", "hashes", mask.alias("mask"), "gram_hashes")
    step = step.select(*counted, F.size("words").cast("long").alias("n_words"), "words", "mask", ordered.alias("ordered"), "gram_hashes")
    step = step.select(*counted, "n_words", "words", alike.alias("alike"), "gram_hashes")
    step = step.select(*counted, "n_words", spelt.alias("spelt"), F.col("gram_hashes").alias("hashes"))
    table = ratios.scalar()
    step = step.select(*counted, "n_words", places.alias("places"), grams.alias("grams"), table.alias("ratios"))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get("ratios", g.cast("int")))
    score = F.coalesce(F.round(F.try_divide(total, F.size("grams")), 9), F.lit(0.0))
    # Not deterministic to Catalyst, so no filter on the verdict is pushed below this step: it would repeat the steps' expressions within each other.
    score = F.when(F.monotonically_increasing_id() >= 0, score)
    step = step.select(*counted, "n_words", covered.alias("n_repeat_words"), score.alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row for each row of df, repeated rows and rows without an id included; an empty table gives no rows."""
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return assess(docs, log_ratios(docs, trusted_ids(labels, max_trusted), buckets), buckets, threshold)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of df that quality() keeps, with all of their columns."""
    row = "row"
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    buckets, threshold, most = how.get("buckets", BUCKETS), how.get("threshold", THRESHOLD), how.get("max_trusted", MAX_TRUSTED)
    ratios = log_ratios(docs.select("doc_id", "text"), trusted_ids(labels, most), buckets)
    return assess(docs, ratios, buckets, threshold, (row,)).where("kept").select(f"{row}.*")

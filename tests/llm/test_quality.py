from __future__ import annotations

import math
import random
import re
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from papyrus.llm import quality, queries

BUCKETS = quality.BUCKETS


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_text(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), 42))


def hash_pair(a, b=None):
    seed = 42
    for x in (a, b):
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def grams(text):
    own = [hash_text(t) for t in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", (text or "").lower())]
    return [h % BUCKETS for h in own] + [hash_pair(*own[i : i + 2]) % BUCKETS for i in range(len(own))]


def test_query_by_brute_force(spark, sf_dir, texts):
    good = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").collect()}
    raw, target, own = Counter(), Counter(), {d: grams(t) for d, t in texts.items()}
    for d, g in own.items():
        raw.update(g)
        if d in good:
            target.update(g)
    n_raw, n_target = raw.total(), target.total()
    ratio = [math.log((target[b] + 1) / (n_target + BUCKETS)) - math.log((raw[b] + 1) / (n_raw + BUCKETS)) for b in range(BUCKETS)]
    found = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for d, t in texts.items():
        r = found[d]
        assert tuple(r[1:6]) == base(t)[:5] and r["base_failed"] == base(t)[5]
        score = sum(ratio[b] for b in own[d]) / len(own[d]) if own[d] else 0.0
        assert math.isclose(r["score"], score, abs_tol=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_repeated_windows_of_a_long_text(spark):
    """A million words, many of them repeats: the counts are those of the words themselves."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(300)}" for _ in range(1_000_000)]
    short = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(words), *short])], "doc_id long, text string")
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert found == {k: base(t)[4] for k, t in enumerate([" ".join(words), *short])}


def test_labelled_documents(spark, sf_dir):
    """Documents of good quality that the base rules pass are kept, the others go."""
    found = queries.op2_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), ["doc_id"]).where("not base_failed")
    right = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.99


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd_docs, none).collect()
    assert len(rows) == odd_docs.count()
    one = next(r for r in rows if r["doc_id"] == 1)
    assert tuple(one) == (1, 0, 0, 0, 0, 0, True, 0.0, False)
    assert all(r["n_repeat_words"] == 90 and r["base_failed"] for r in rows if r["doc_id"] == 4)
    assert quality.quality(no_docs, none).count() == 0
    labels = spark.createDataFrame([(4, 1, None), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(odd_docs, labels).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns

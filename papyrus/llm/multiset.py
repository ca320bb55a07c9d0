"""Homomorphic multiset hash of a text's paragraphs.

A text is the multiset of its paragraphs: its lines, cut at sentence ends and, within a sentence, after every eight words,
so that one edit touches few of them. Each paragraph is hashed to a wide vector, and a fingerprint is the sum of those
vectors, lane by lane, modulo 2^16: the order does not matter, equal multisets have equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector. The first ``WIDE`` lanes are uniform 16-bit numbers (they tell
different multisets apart); the other ``SIGNS`` lanes are +1 or -1, so that the inner product of two fingerprints estimates
the overlap of the two multisets; likeness() is their cosine.

The 512 bits of the uniform lanes make accidental collisions negligible (2^-256 by the birthday bound). They do not
withstand someone who searches for colliding multisets: that takes about a thousand lanes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

WIDE, SIGNS, WORDS = 32, 256, 8
LANES = WIDE + SIGNS
_END = re.compile(r"\n|(?<=[.!?]) ")
#: Paragraphs whose vectors are expanded at a time.
BLOCK = 1 << 14


def paragraphs(text: str) -> list[bytes]:
    out = []
    for part in _END.split(text):
        if part.count(" ") < WORDS:
            if part:
                out.append(part)
        else:
            words = part.split(" ")
            out += [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
    return [p.encode("utf-8", "surrogatepass") for p in out]


def vector_sum(parts: Iterable[bytes]) -> np.ndarray:
    """LANES unsigned 16-bit numbers: the sum of the paragraphs' vectors."""
    parts, total = list(parts), np.zeros(LANES, np.uint16)
    for lo in range(0, len(parts), BLOCK):
        block = parts[lo : lo + BLOCK]
        wide = b"".join([hashlib.blake2b(p, digest_size=2 * WIDE).digest() for p in block])
        signs = b"".join([hashlib.blake2b(p, digest_size=SIGNS // 8, person=b"signs").digest() for p in block])
        total[:WIDE] += np.frombuffer(wide, "<u2").reshape(-1, WIDE).sum(axis=0, dtype=np.uint16)
        ones = np.unpackbits(np.frombuffer(signs, np.uint8).reshape(len(block), -1), axis=1).sum(axis=0, dtype=np.int64)
        total[WIDE:] += (2 * ones - len(block)).astype(np.uint16)
    return total


def insert(fingerprint: np.ndarray, text: str) -> np.ndarray:
    return fingerprint + vector_sum(paragraphs(text))


def delete(fingerprint: np.ndarray, text: str) -> np.ndarray:
    return fingerprint - vector_sum(paragraphs(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of the sign lanes, from 0 to 1; equal fingerprints are 1 alike, also two empty ones."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[WIDE:].view(np.int16).astype(np.float64), b[WIDE:].view(np.int16).astype(np.float64)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return round(min(1.0, max(0.0, float(x @ y) / size)), 6) if size else 0.0


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype("<u2").tobytes().hex()


def from_text(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), "<u2").astype(np.uint16)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): a row for each row of df; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_text(vector_sum(paragraphs(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    own = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, "doc_id long, fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text) in which each row's next one in descending doc_id follows it within a partition.

    The ids are cut at quantiles into buckets of about equal size. The first row of a bucket is also added, marked
    ``ahead``, to the end of the bucket before it (of the first bucket: to the last), so the texts are shuffled once and no
    task sees more than a bucket at a time. Rows without an id come last; ties are ordered by a hash of the text.
    """
    spark = df.sparkSession
    own = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or min(2000, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # At most n numbers reach the driver, here and below.
    cuts = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: F.col("doc_id") < c)) if cuts else F.lit(0)
    own = own.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place)).withColumn("tie", F.xxhash64("text"))
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "tie")).alias("first")
    heads = sorted((r["bucket"], r["first"][0], r["first"][1]) for r in own.groupBy("bucket").agg(first).collect())
    rows = [(b, heads[k - 1][0], i, t) for k, (b, i, t) in enumerate(heads)]
    firsts = spark.createDataFrame(rows, "bucket int, before int, head long, head_tie long")
    marked = own.join(F.broadcast(firsts), ["bucket"])
    is_head = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("head")) & (F.col("tie") == F.col("head_tie"))
    here, there = F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
    placed = marked.select(F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("p"), "doc_id", "text", "tie")
    dealt = placed.select("p.bucket", "p.ahead", "doc_id", "text", "tie").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).drop("tie")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of df.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document
    in descending doc_id; after the last comes the first, so a single document is its own next one. Null texts count as
    empty. An empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for batch in batches:
            for bucket, ahead, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and (before is None or before[0] != bucket):
                    continue  # a further row with the id and text of the one that was looked ahead to
                fp = vector_sum(paragraphs(text))
                if before is not None and before[0] == bucket:
                    _, own, old, old_fp = before
                    k = len(old) // 3
                    edited = old[: len(old) - k] + text[:k]
                    new_fp = vector_sum(paragraphs(edited))
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own, len(old), digest, to_text(old_fp), to_text(new_fp), likeness(old_fp, new_fp), likeness(old_fp, fp)))
                before = None if ahead else (bucket, doc, text, fp)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, id_col, text_col).mapInArrow(run, schema)

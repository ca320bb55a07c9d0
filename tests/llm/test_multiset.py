from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from papyrus.llm import multiset, queries


@given(st.text(max_size=200), st.text(max_size=200))
def test_insert_and_delete(a, b):
    own = multiset.vector_sum(multiset.paragraphs(a))
    assert np.array_equal(multiset.delete(multiset.insert(own, b), b), own)
    assert np.array_equal(multiset.insert(own, b), multiset.vector_sum(multiset.paragraphs(b) + multiset.paragraphs(a)))
    assert np.array_equal(multiset.from_text(multiset.to_text(own)), own)


def test_order_does_not_matter_and_counts_do():
    def fp(t):
        return multiset.to_text(multiset.vector_sum(multiset.paragraphs(t)))

    assert fp("a\nb\nc") == fp("c\na\nb") != fp("a\na\nb\nc") != fp("a\nb\nb\nc")


def brute(rows):
    """rows of (doc_id, text), ids unique."""
    rows = sorted(rows, reverse=True)
    out = {}
    for k, (doc, text) in enumerate(rows):
        new = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + new[:n]
        fps = [multiset.vector_sum(multiset.paragraphs(t)) for t in (text, edited, new)]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), multiset.to_text(fps[0]), multiset.to_text(fps[1]), multiset.likeness(fps[0], fps[1]), multiset.likeness(fps[0], fps[2]))
    return out


def test_query_by_brute_force(spark, sf_dir, texts):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_multiset_hash(spark, sf_dir).collect()}
    assert found == brute(texts.items())
    near, far = (sum(r[k] for r in found.values()) / len(found) for k in (4, 5))
    assert near > 0.5 > 0.2 > far
    single = multiset.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r[0]: r[1] for r in single.collect()} == {d: r[2] for d, r in found.items()}


def test_any_number_of_buckets(spark):
    for n in (1, 2, 7):
        rows = [(k * k - 5, f"text {k}. " * k) for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: tuple(r)[1:] for r in multiset.edited_fingerprints(df).collect()} == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = multiset.edited_fingerprints(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    one = next(r for r in rows if r["doc_id"] == 1)
    assert (one["n_chars"], one["edited_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert multiset.edited_fingerprints(no_docs).count() == 0

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papyrus.llm import packing, queries

PATH = packing.word_tokenizer()
WHOLE = Tokenizer.from_file(PATH)
OWN = packing.ChunkTokenizer(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("aZé'sLL09² \x1c\t\n.,<|endofxt>", max_size=40)), max_size=4))
def test_tokenizer_equals_the_whole_one(texts):
    want = [array("I", WHOLE.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert [OWN.encode(t) for t in texts] == want


def test_special_tokens_in_a_text():
    t = "a<|endoftext|>b <|startoftext|>"
    assert OWN.encode(t) == array("I", WHOLE.encode(t, add_special_tokens=False).ids).tobytes()


@settings(deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([1, 4, 16]), st.sampled_from([4, 16, 64]))
def test_bins_hold_every_token_once(lengths, least, classes):
    bins, out, total = packing.HarmonicBins(128, classes, least), [], sum(lengths)
    for doc, n in enumerate(lengths):
        out += bins.add(doc, array("I", range(n)).tobytes())
        assert len(bins.open) <= classes
    n_bins = len(out)
    out += bins.close()
    sizes = [sum(len(ids) // 4 for _, _, ids, _ in s) for s in out]
    assert all(0 < n <= 128 for n in sizes) and sum(sizes) == total
    got = defaultdict(list)
    for s in out:
        for doc, start, ids, n in s:
            assert n == lengths[doc]
            got[doc].append((start, array("I", ids).tolist()))
    assert {d: [x for _, ids in sorted(parts) for x in ids] for d, parts in got.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
    assert all(n > 128 - 2 * least for n in sizes[:n_bins])


def test_class_counts():
    """Without long documents to cut, a bin of class k closes with k documents: three of 40 in 128, and a piece of the fourth."""
    bins = packing.HarmonicBins(128, 64, 8)
    closed = [bins.add(d, bytes(4 * 40)) for d in range(4)]
    assert [len(c) for c in closed] == [0, 0, 0, 1]
    ((first, second, third, fourth),) = closed[3]
    assert [p[0] for p in (first, second, third, fourth)] == [0, 1, 2, 3] and len(fourth[2]) == 4 * 8


def check(pieces, docs, capacity=2048, most_padding=0.0):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    padded = total = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert padded <= most_padding * total
    assert set(by_doc) == set(docs)
    for doc, text in docs.items():
        ids, at = ids_of(text), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)


def test_query_by_brute_force(spark, sf_dir, texts):
    rows = [r.asDict() for r in queries.op1_harmonic_packing(spark, sf_dir).collect()]
    check(rows, texts, most_padding=0.005)
    assert len(rows) < 3 * len(texts)


def test_larger_pieces(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in packing.pack_documents(docs, PATH, capacity=256, min_piece=16).collect()]
    check(rows, texts, 256, 0.1)
    many = [r.asDict() for r in packing.sequences(packing.pack_documents(docs, PATH, capacity=256, min_piece=16), 256).collect()]
    assert sum(r["n_tokens"] for r in many) == sum(len(ids_of(t)) for t in texts.values())
    assert all(len(r["ids"]) == 4 * (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 256) for r in many)


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6, -7}
    assert [(r["length"], r["ids"]) for r in rows if r["doc_id"] in (1, 2, 3)] == [(1, b"\x01\0\0\0")] * 3
    assert sum(r["start"] == 0 for r in rows if r["doc_id"] == 4) == 2
    assert packing.pack_documents(no_docs, PATH).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack_documents(odd_docs, PATH, capacity=0)

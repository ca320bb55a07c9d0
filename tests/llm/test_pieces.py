from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrus.llm import pieces, queries

S = pieces.PieceSampler(pieces.model_path())
MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab ▁\n\tthe", max_size=30)), st.integers())
def test_round_trip(text, key):
    ids = S.encode(text, key)
    assert S.decode(ids) == text
    assert ids == S.encode_batch(["other", text, "more words"], [1, key, 2])[1].tolist()
    if "▁" not in text:
        assert MODEL.decode(ids) == text


def test_long_part():
    text = "ab" * 5000 + "日" * 3000
    assert S.decode(S.encode(text, 1)) == text


def segmentations(part):
    if not part:
        yield ()
    for k in range(1, len(part) + 1):
        if part[:k] in S.weights:
            yield from ((part[:k], *rest) for rest in segmentations(part[k:]))


def test_each_segmentation_has_its_share():
    every = list(segmentations("▁theres"))
    weight = np.array([np.prod([S.weights[p][0] for p in s]) for s in every])
    n = 20_000
    got = Counter(tuple(S.plain[i].decode().replace(" ", "▁") for i in ids) for ids in S.encode_batch(["theres"] * n, list(range(n))))
    assert set(got) <= set(every)
    assert max(abs(got[s] / n - w) for s, w in zip(every, weight / weight.sum(), strict=True)) < 0.012


U64 = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & U64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & U64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & U64
    return x ^ (x >> 31)


def parts_of(text):
    """Runs of space marks with the characters after them, line ends; a space mark of the text itself apart, as None."""
    out = []
    for k, piece in enumerate(text.split("▁")) if text else ():
        out += [None] * (k > 0) + re.findall("▁*[^▁\n]+|▁+|\n", ("▁" if k == 0 else "") + piece.replace(" ", "▁"))
    return out


def brute_ids(text, key, seed, known):
    """Forward sums in fractions of the part's own total, backward draws one by one."""
    ids, start = [], mixed((zlib.crc32(repr((seed, key)).encode()) + (seed << 32)) & U64)
    for number, part in enumerate(parts_of(text)):
        if part is None:
            ids += [S.bytes_ids[b] for b in "▁".encode()]
            continue
        if part not in known:
            sums, ends = [Fraction(1)], []
            for j in range(1, len(part) + 1):
                found = [(Fraction(S.weights[part[i:j]][0]) * sums[i], i, [S.weights[part[i:j]][1]]) for i in range(j - 1, -1, -1) if part[i:j] in S.weights]
                if part[j - 1] not in S.weights:
                    raw = part[j - 1].encode()
                    found.insert(0, (Fraction(pieces.BYTE_WEIGHT ** len(raw)) * sums[j - 1], j - 1, [S.bytes_ids[b] for b in raw]))
                sums.append(sum(w for w, _, _ in found))
                ends.append(found)
            known[part] = (sums, ends)
        sums, ends = known[part]
        own, at, step, back = mixed((start + number) & U64), len(part), 0, []
        while at:
            u = Fraction(mixed((own + step * 0x632BE59BD9B4E019) & U64) >> 11, 1 << 53) * sums[at]
            for w, i, got in ends[at - 1]:
                u -= w
                if u < 0:
                    break
            back, at, step = [*got, *back], i, step + 1
        ids += back
    return ids


def test_ids_by_brute_force(spark, sf_dir, texts):
    known = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in pieces.sample_pieces(docs, pieces.model_path(), seed=42).collect()}
    assert found == {d: brute_ids(t or "", d, 42, known) for d, t in texts.items()}
    for text in ("ab" * 200 + "日本" * 30, "x" * 600, "▁ a▁" + "the" * 120):
        assert S.encode(text, 7, 3) == brute_ids(text, 7, 3, known)


def test_very_long_text_without_spaces():
    began, text = time.process_time(), "thequickbrownfox" * 20_000
    assert S.decode(S.encode(text, 1)) == text and time.process_time() - began < 60


def test_query(spark, sf_dir, texts):
    first = {r["doc_id"]: tuple(r) for r in queries.op6_sampled_pieces(spark, sf_dir).collect()}
    assert set(first) == set(texts) and all(r[3] for r in first.values())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    again = pieces.sample_pieces(docs, pieces.model_path(), seed=42)
    assert {r["doc_id"]: len(r["ids"]) // 4 for r in again.collect()} == {d: r[1] for d, r in first.items()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_pieces(again, pieces.model_path()).collect()} == texts


def test_odd_rows(odd_docs, no_docs):
    rows = pieces.sample_pieces(odd_docs, pieces.model_path()).collect()
    assert len(rows) == odd_docs.count() and all(r["lossless"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert pieces.sample_pieces(no_docs, pieces.model_path()).count() == 0

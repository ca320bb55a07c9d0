"""Alignments against a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
import time
from collections import Counter

import pytest

from papyrus.llm import align
from papyrus.llm.queries import op11_token_alignment


@pytest.fixture(scope="module")
def plain():
    """Text -> tokens of A and B as (id, bytes), or None; by the tokenizers themselves over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.tokenizer_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def of(text):
        if not text:
            return None
        one = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
        return (one, two) if b"".join(x[1] for x in one) == b"".join(x[1] for x in two) == (" " + text).encode() else None

    return of


def groups_of(tokens):
    """[(ids of A, ids of B)] by walking both sides to the next common end."""
    one, two = tokens
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(one):
        a, b = [one[i][0]], [two[j][0]]
        at_a, at_b, i, j = at_a + len(one[i][1]), at_b + len(two[j][1]), i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                a.append(one[i][0])
                at_a, i = at_a + len(one[i][1]), i + 1
            else:
                b.append(two[j][0])
                at_b, j = at_b + len(two[j][1]), j + 1
        out.append((a, b))
    return out


def brute(plain, rows):
    found = [(doc, groups_of(t) if (t := plain(text)) else None) for doc, text in rows]
    counts, best = Counter(), Counter()
    for _, groups in found:
        counts.update({(a, b) for g in groups or [] for a in g[0] for b in g[1]})
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc, groups in found:
        if groups is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = ["plain words here", "  two spaces  and more   ", "tabs\tand\nlines\n\n next", " \n", " no break   em", "ｆｕｌｌ ﬁ é é", "日本語 テキスト です", "a<|endoftext|> b <s> </s> <unk> <0x41>", "▁ is B's space", "x▁y z", "emoji 👩‍👩‍👧 🎉🎉", "zero\x00 and \x1c \x85   ends", "1234567890 12 3.14159", "don't we'll I'm 'tis", "camelCase_snake-kebab/path.to:thing?x=1&y=2", "ﷺ ﷺ word", "x" * 3000, "ab" * 2000 + " " + "-" * 777, "Ünïcödé straße ŒUVRE", "﻿bom ​ zero"]


def test_query_equals_plain_walk(spark, sf_dir, plain, texts, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 50_000)  # several chunks
    found = op11_token_alignment(spark, sf_dir)
    assert found.columns == [x.split()[0] for x in align.RESULT.split(", ")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(plain, list(texts.items()))


def test_odd_texts(spark, plain, odd_docs, no_docs):
    rows = [*enumerate(ODD), (1, None), (2, ""), (None, "no id"), (7, ODD[7]), (9, " ".join(ODD))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pos string, kind int")
    paths = align.tokenizer_paths()
    assert sorted((tuple(r) for r in align.link_statistics(df, *paths).collect()), key=repr) == brute(plain, rows)
    assert align.link_statistics(odd_docs, *paths).count() == odd_docs.count()
    assert align.link_statistics(no_docs, *paths).count() == 0


@pytest.mark.parametrize("chunk", [40, 4 << 20])
def test_white_space_at_ends_stays_with_its_own_text(spark, plain, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK_BYTES", chunk)
    texts = ["   ", "abc def", "", "abc", "a ", "b c", "\u3000", "b", "x \n", "\ny z", " \x1c\r\n", "word", "a  b", "c b", "d", None, "d\u2028", "\x85e  ", " "]
    rows = list(enumerate(texts + texts[::-1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # neighbours in one chunk
    assert sorted((tuple(r) for r in align.link_statistics(df, *align.tokenizer_paths()).collect()), key=repr) == brute(plain, rows)


def test_overlaps_are_the_tokens_that_share_a_byte(spark, plain):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in align.alignments(df, *align.tokenizer_paths()).collect():
        tokens = plain(ODD[r["doc_id"]])
        if tokens is None:
            assert not r["a_ids"] and not r["overlaps"]
            continue
        spans = []
        for side in tokens:
            ends = [0]
            for _, x in side:
                ends.append(ends[-1] + len(x))
            spans.append(list(zip(ends[:-1], ends[1:])))
        assert [x[0] for x in tokens[0]] == list(r["a_ids"]) and [x[0] for x in tokens[1]] == list(r["b_ids"])
        if len(spans[0]) < 500:
            assert sorted((o["a"], o["b"]) for o in r["overlaps"]) == sorted((i, j) for i, a in enumerate(spans[0]) for j, b in enumerate(spans[1]) if a[0] < b[1] and b[0] < a[1])


def test_large_groups_keep_all_links(monkeypatch):
    tok = align.tokenizers(*align.tokenizer_paths())
    parts = ["x" * 500, "abcabcabd" * 40, "word", "日本語テキスト" * 9]
    want = [x.tolist() for x in align.Aligned(tok, parts).pairs()]
    monkeypatch.setattr(align, "LARGE_GROUP", 1)
    assert [x.tolist() for x in align.Aligned(tok, parts).pairs()] == want


def test_long_parts_take_linear_time():
    tok = align.tokenizers(*align.tokenizer_paths())
    began = time.time()
    for part in ("x" * 300_000, "qzjvkx" * 50_000, "日本" * 50_000, "a b " * 100_000):
        assert align.Aligned(tok, [part]).sound[0]
    assert time.time() - began < 60

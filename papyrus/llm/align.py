"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each linked pair of ids is.

A is a byte-level BPE, B a piece BPE with byte fallback; both read a text behind one space. Neither has a token that goes on
over a single space between two characters that are no white space, so a text's parts between such spaces have the same tokens
wherever they stand. A worker takes whole documents until it has CHUNK_BYTES of text, tokenizes the distinct parts of these, and
aligns them all at once: ``merge_asof``, keyed by part, finds for each token start of A the token of B that covers it, and the
other way round. The union of both directions is all overlaps; a start that is also the start of its covering token begins a
group, as there both sides' previous tokens end. What documents need is then summed over their parts.

Counts of id pairs are of the whole corpus: a chunk's distinct pairs with the number of its documents that hold them are added up by
a shuffle, each pair's count goes back to the chunks that hold it, and a chunk's documents are summed up there. So what is
shuffled are the distinct pairs of chunks, not those of documents. Chunks are kept as a Parquet table in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.llm.common import pick, shared_dir

#: Text that a chunk of documents holds (a longer document is a chunk of its own), text that B is given at once.
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 17
#: Pairs of documents' parts that are looked at together.
EXPANDED = 1 << 19
#: A pair of ids is a * PAIR + b. Groups with more links than LARGE_GROUP are expanded from their distinct ids.
PAIR, LARGE_GROUP = 1 << 16, 1 << 16


class Tokenizers:
    """A and B with the byte lengths and decimal forms of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        if a_path.endswith(".json"):  # the same vocabulary: characters of the byte-level alphabet stand for bytes
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
            with open(a_path, encoding="utf-8") as f:
                given = json.load(f)
            special = {t["content"] for t in given["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): k for token, k in given["model"]["vocab"].items() if token not in special}
        else:
            with open(a_path, "rb") as f:
                ranks = {base64.b64decode(t): int(k) for t, k in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_len[list(ranks.values())] = [len(t) for t in ranks]
        self.b_len = np.array([len(t) for t in self.b_bytes])
        # Decimal forms with what follows them: a comma within a side of a group; after A's last a bar, after B's last a semicolon.
        self.a_text, self.b_text = (np.array([[f"{k}{end}" for k in range(n)] for end in ends], dtype=object) for n, ends in ((len(self.a_len), ",|"), (len(self.b_len), ",;")))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, whether B keeps the part's bytes) of parts that each stand behind a space; ids of the sound parts only, in order."""
        sound, b_ids = np.ones(len(parts), dtype=bool), []
        for at, to in _runs(parts, PIECE_BYTES):
            text = " ".join(parts[at:to])
            ids = self.b.encode(text)
            if b"".join([self.b_bytes[k] for k in ids]) == b" " + text.encode("utf-8", "surrogatepass"):
                b_ids += ids
            else:
                for k, (part, ids) in enumerate(zip(parts[at:to], self.b.encode(parts[at:to]), strict=True), at):
                    sound[k] = b"".join([self.b_bytes[i] for i in ids]) == b" " + part.encode("utf-8", "surrogatepass")
                    if sound[k]:
                        b_ids += ids
        kept = parts if sound.all() else [p for p, s in zip(parts, sound, strict=True) if s]
        a_ids = [self.a.encode_to_numpy(" " + " ".join(kept[at:to]), disallowed_special=()) for at, to in _runs(kept)]
        return np.concatenate([np.zeros(0, dtype=np.int64), *a_ids]).astype(np.int64), np.array(b_ids, dtype=np.int64), sound


def _runs(parts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of parts that can be read as one text, at most ``most`` bytes or one part: white space at a part's end or start, or an empty part, makes one token with the space between."""
    sizes = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
    apart = [k for k in range(1, len(parts)) if not parts[k - 1] or not parts[k] or parts[k - 1][-1].isspace() or parts[k][0].isspace()]
    at = 0
    for end in [*apart, len(parts)]:
        while at < end:
            to = end if most is None else min(end, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))))
            yield at, to
            at = to


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def covering(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """one's tokens (key, start) with the place and start of other's token that covers their start, within the same key."""
    return pd.merge_asof(one, other.assign(place=np.arange(len(other)), other_start=other["start"]), on="start", by="key")


class Aligned:
    """Groups of parts: of each token its part and group, of each group and part how many tokens and links."""

    def __init__(self, tok: Tokenizers, parts: list[str]) -> None:
        self.a, self.b, self.sound = tok.encode(parts)
        sizes = np.array([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts], dtype=np.int64)[self.sound]
        self.parts = np.flatnonzero(self.sound)
        ends = np.cumsum(sizes)
        a_start, b_start = (np.concatenate([[0], np.cumsum(n[ids])[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64) for ids, n in ((self.a, tok.a_len), (self.b, tok.b_len)))
        one, two = (pd.DataFrame({"start": s, "key": np.searchsorted(ends, s, "right")}) for s in (a_start, b_start))
        self.of_a, self.of_b = covering(one, two), covering(two, one)
        self.a_group, self.b_group = (np.cumsum((x["start"] == x["other_start"]).to_numpy()) - 1 for x in (self.of_a, self.of_b))
        n = int(self.a_group[-1]) + 1 if len(self.a) else 0
        self.a_count, self.b_count = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        self.a_first, self.b_first = (np.concatenate([[0], np.cumsum(c)]) for c in (self.a_count, self.b_count))
        self.part_of_group = one["key"].to_numpy()[self.a_first[:-1]] if n else np.zeros(0, dtype=np.int64)
        self.tok = tok

    def overlaps(self) -> np.ndarray:
        """(place in A, place in B) of all tokens that share a byte: the covering tokens of both directions."""
        both = [np.stack([np.arange(len(self.a)), self.of_a["place"].to_numpy(dtype=np.int64)], axis=1), np.stack([self.of_b["place"].to_numpy(dtype=np.int64), np.arange(len(self.b))], axis=1)]
        return np.unique(np.concatenate(both), axis=0)

    def per_part(self, of_group: np.ndarray, parts: int) -> np.ndarray:
        """Sums over the groups of each of ``parts`` parts; 0 for those that are not sound."""
        ends = np.searchsorted(self.part_of_group, np.arange(len(self.parts)), "right")
        total = np.concatenate([[0], np.cumsum(of_group)])[np.concatenate([[0], ends])]
        out = np.zeros(parts, dtype=np.int64)
        out[self.parts] = np.diff(total)
        return out

    def texts(self, parts: int) -> list[str]:
        """The decimal form of each part's groups, each with a semicolon behind it."""
        cells = np.empty(len(self.a) + len(self.b), dtype=object)
        for ids, group, first, before, table in ((self.a, self.a_group, self.a_first, self.b_first[:-1], self.tok.a_text), (self.b, self.b_group, self.b_first, self.a_first[1:], self.tok.b_text)):
            last = np.zeros(len(ids), dtype=np.int64)
            last[first[1:] - 1] = 1
            cells[np.arange(len(ids)) + before[group]] = table[last, ids]
        ends = np.searchsorted(self.part_of_group, np.arange(len(self.parts)), "right")
        cuts = np.concatenate([[0], (self.a_first + self.b_first)[ends]]).tolist()
        out, cells = [""] * parts, cells.tolist()
        for k, part in enumerate(self.parts.tolist()):
            out[part] = "".join(cells[cuts[k] : cuts[k + 1]])
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, pair of ids, links) of all links, by part and pair without repeats."""
        links = self.a_count * self.b_count
        plain = links <= LARGE_GROUP
        a_at = np.flatnonzero(plain[self.a_group])
        times = self.b_count[self.a_group[a_at]]
        row = np.repeat(np.arange(len(a_at)), times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        group = self.a_group[a_at][row]
        part, pair, weight = [self.part_of_group[group]], [self.a[a_at][row] * PAIR + self.b[self.b_first[group] + nth]], [np.ones(len(row), dtype=np.int64)]
        for g in np.flatnonzero(~plain).tolist():
            (x, m), (y, n) = (np.unique(ids[f[g] : f[g + 1]], return_counts=True) for ids, f in ((self.a, self.a_first), (self.b, self.b_first)))
            pair.append((x[:, None] * PAIR + y[None, :]).reshape(-1))
            weight.append((m[:, None] * n[None, :]).reshape(-1))
            part.append(np.full(len(pair[-1]), self.part_of_group[g]))
        part, pair, weight = np.concatenate(part), np.concatenate(pair), np.concatenate(weight)
        key = (part << 32) + pair
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        return self.parts[key[new] >> 32], key[new] & 0xFFFFFFFF, np.add.reduceat(weight, new) if len(new) else weight


def _joined(segments: list[str]) -> list[str]:
    """A text's parts: its segments between spaces, put together again where white space stands beside the space (or none stands between)."""
    parts = [segments[0]]
    for segment in segments[1:]:
        if segment and not segment[0].isspace() and parts[-1] and not parts[-1][-1].isspace():
            parts.append(segment)
        else:
            parts[-1] += " " + segment
    return parts


def parts_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts, part of each occurrence, first occurrence of each text and their end) of texts without nulls."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    odd_start, odd_end = (np.array([not w or w[k].isspace() for w in words], dtype=bool) for k in (0, -1))
    if not len(index):
        return words, index, first
    odd = odd_start[index]
    odd[1:] |= odd_end[index[:-1]]
    odd[first[:-1]] = False  # a text's first segment stands behind the space that both tokenizers read first
    if not odd.any():
        return words, index, first
    known = {w: k for k, w in enumerate(words)}
    again = np.logical_or.reduceat(odd, first[:-1])
    out, sizes = [], counts.copy()
    for k in range(len(counts)):
        own = index[first[k] : first[k + 1]]
        if again[k]:
            own = np.array([known.setdefault(p, len(known)) for p in _joined([words[i] for i in own])], dtype=np.int64)
            sizes[k] = len(own)
        out.append(own)
    return list(known), np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True) if len(key) else (key, key)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed bytes."""
    raw = b"".join(a.astype("<i8").tobytes() for a in arrays)
    sizes = np.array([len(arrays), *map(len, arrays)], dtype="<i8").tobytes()
    return sizes + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", n, 8)
    raw = pa.decompress(blob[8 * (n + 1) :], decompressed_size=int(sizes.sum()) * 8, codec="zstd", asbytes=True)
    return np.split(np.frombuffer(raw, "<i8"), np.cumsum(sizes)[:-1])


CHUNK = "chunk_id long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,sha:string>>, of_docs binary, of_parts binary, pairs array<long>, in_docs array<long>"
_DOC = pa.struct([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.string())])
_CHUNK = pa.schema([("chunk_id", pa.int64()), ("docs", pa.list_(_DOC)), ("of_docs", pa.binary()), ("of_parts", pa.binary()), ("pairs", pa.list_(pa.int64())), ("in_docs", pa.list_(pa.int64()))])


def chunk_row(tok: Tokenizers, chunk_id: int, ids: list, texts: pa.Array) -> pa.RecordBatch:
    """One row of CHUNK: what each document sums up to, its distinct parts, the pairs of each part, and in how many documents each pair stands."""
    words, index, first = parts_of(texts)
    aligned = Aligned(tok, words)
    n_docs, n_parts = len(ids), len(words)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    whole = np.ones(n_docs, dtype=bool)
    whole[doc[~aligned.sound[index]]] = False
    whole &= np.array([bool(t) for t in pc.greater(pc.binary_length(texts), 0).to_pylist()], dtype=bool)
    keep = whole[doc]
    doc, index = doc[keep], index[keep]
    sums = []
    for of_group in (aligned.a_count, aligned.b_count, np.ones(len(aligned.a_count), dtype=np.int64), aligned.a_count * aligned.b_count):
        total = np.concatenate([[0], np.cumsum(aligned.per_part(of_group, n_parts)[index])])
        sums.append(np.diff(total[np.searchsorted(doc, np.arange(n_docs + 1))]).tolist())
    said, spans, digests = aligned.texts(n_parts), np.searchsorted(doc, np.arange(n_docs + 1)).tolist(), []
    for k in range(n_docs):
        own = "".join([said[i] for i in index[spans[k] : spans[k + 1]].tolist()])
        digests.append(hashlib.sha256(own[:-1].encode()).hexdigest() if own else "")
    held, times = _unique(doc * n_parts + index)
    held_doc, held_part = held // max(1, n_parts), held % max(1, n_parts)
    part, pair, links = aligned.pairs()
    pairs, pair = np.unique(pair, return_inverse=True)
    part_first = np.searchsorted(part, np.arange(n_parts + 1))
    in_docs = np.zeros(len(pairs), dtype=np.int64)
    many = np.diff(part_first)[held_part]
    ends, doc_ends, at = np.cumsum(many), np.searchsorted(held_doc, np.arange(n_docs), "right"), 0
    while at < len(many):  # whole documents, about EXPANDED pairs at a time
        to = int(doc_ends[held_doc[min(len(many) - 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))]])
        own = many[at:to]
        nth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        seen = np.unique(np.repeat(held_doc[at:to], own) * len(pairs) + pair[np.repeat(part_first[held_part[at:to]], own) + nth])
        in_docs += np.bincount(seen % len(pairs), minlength=len(pairs))
        at = to
    docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"), row, strict=True)) for row in zip(ids, *sums, digests, strict=True)]
    of_docs = _blob(np.searchsorted(held_doc, np.arange(n_docs + 1)), np.diff(held_part, prepend=0), times)
    return pa.RecordBatch.from_arrays([pa.array([chunk_id]), pa.array([docs], pa.list_(_DOC)), pa.array([of_docs]), pa.array([_blob(part_first, pair, links)]), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([in_docs.tolist()], pa.list_(pa.int64()))], schema=_CHUNK)


def write_chunks(docs: DataFrame, a_path: str, b_path: str, path: str) -> None:
    """CHUNK rows of docs (doc_id, text) as a Parquet table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base, n = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal n, size
            table = pa.Table.from_batches(held)
            held.clear()
            n, size = n + 1, 0
            return chunk_row(tok, base + n, table.column(0).to_pylist(), table.column(1).combine_chunks())

        for batch in batches:
            text = batch.column(1).fill_null("")
            batch = pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], ["doc_id", "text"])
            ends, at = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES - size, "right")))
                if held and ends[to - 1] - done + size > CHUNK_BYTES:  # the next document fills the chunk over
                    yield close()
                    continue
                held.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1]) - done, to
                if size >= CHUNK_BYTES:
                    yield close()
        if held:
            yield close()

    docs.mapInArrow(run, CHUNK).write.parquet(path)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_statistics(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for every row of df.

    Texts that are null, empty or that B does not keep byte by byte have no tokens: zeros and an empty groups_sha256; they count for no
    pair. Repeated rows are documents of their own. Special tokens' strings are plain text.
    """
    spark = df.sparkSession
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    path = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    write_chunks(docs, a_path, b_path, path)
    chunks = spark.read.schema(CHUNK).parquet(path)
    held = chunks.select("chunk_id", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("pos", "x")).select("chunk_id", "pos", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 16))  # at most as many rows as B has ids
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))
    found = held.join(counts, ["pair"]).select("chunk_id", F.lit(1).alias("kind"), "pos", "count", "best")
    known = chunks.select("chunk_id", F.lit(0).alias("kind"), "docs", "of_docs", "of_parts")
    both = known.unionByName(found, allowMissingColumns=True)
    dealt = both.repartition("chunk_id").sortWithinPartitions("chunk_id", "kind", "pos").select("kind", "docs", "of_docs", "of_parts", "pos", "count", "best")
    types = [pa.int64()] * 7 + [pa.string()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict | None = None
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            if chunk is None:
                return
            count, best = (np.concatenate([c[k] for c in counted]) if counted else np.zeros(0, dtype=np.int64) for k in (0, 1))
            (doc_first, held, times), (part_first, pair, links) = _arrays(chunk["of_docs"]), _arrays(chunk["of_parts"])
            held, sums = np.cumsum(held), []
            for weight in (best.astype(np.int64), count):
                of_part = np.diff(np.concatenate([[0], np.cumsum(links * weight[pair])])[part_first])
                sums.append(np.diff(np.concatenate([[0], np.cumsum(times * of_part[held])])[doc_first]).tolist())
            rows = [(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], b, c, d["sha"]) for d, b, c in zip(chunk["docs"], *sums, strict=True)]
            counted.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(kinds == 0).tolist(), batch.num_rows]
            if cuts[0]:
                counted.append((batch.column(5).slice(0, cuts[0]).to_numpy(zero_copy_only=False), batch.column(6).slice(0, cuts[0]).to_numpy(zero_copy_only=False)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from close()
                chunk = {n: batch.column(k)[a].as_py() for n, k in (("docs", 1), ("of_docs", 2), ("of_parts", 3))}
                if b > a + 1:
                    counted.append(tuple(batch.column(k).slice(a + 1, b - a - 1).to_numpy(zero_copy_only=False) for k in (5, 6)))
        yield from close()

    return dealt.mapInArrow(run, RESULT)


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, overlaps array<struct<a:int,b:int>>"


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ALIGNED for every row of df: both sides' ids, the group of each token, and which tokens share a byte (places from 0). Texts without tokens have empty arrays."""
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    types = [pa.int64()] + [pa.list_(pa.int32())] * 4 + [pair]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (doc, [], [], [], [], [])
                if text:
                    x = Aligned(tok, [text])
                    if x.sound[0]:
                        row = (doc, x.a.tolist(), x.b.tolist(), x.a_group.tolist(), x.b_group.tolist(), [{"a": a, "b": b} for a, b in x.overlaps().tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], [n.split()[0] for n in ("doc_id", "a_ids", "b_ids", "a_group", "b_group", "overlaps")])

    return docs.mapInArrow(run, ALIGNED)


def tokenizer_paths() -> tuple[str, str]:
    """The vocabularies of A and B that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

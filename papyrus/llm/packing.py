"""Harmonic packing of token sequences.

A length of (capacity/(k+1), capacity/k] belongs to the reciprocal class k: whatever the documents are, k of them fit one
sequence. Whole sequences are cut off a long document first, its rest has one of the classes; lengths of at most
capacity/``classes`` share the last one. A class's bin is full after its fixed count of documents. What such a bin leaves
free is given to the next document of the worker, which is cut there once; so a sequence holds whole documents but for its
last piece, and pads less than 2 * ``min_piece`` tokens. Every worker fills its bins alone: no shuffle, no shared state,
memory bounded by one open bin for each class. At a worker's end the pieces of its open bins are laid end to end, and the
last sequence, where padding would cost more than ``END_PADDING`` of it, becomes sequences of powers of two.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from threading import Timer

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a partition start at its number times this.
STRIDE = 1 << 33
#: White-space-free chunks and words whose ids a worker remembers, and the longest ones that it does.
CACHE_CHUNKS, CACHE_WORDS, CACHE_CHARS = 400_000, 400_000, 48
IDLE_SECONDS = 5.0
#: Reciprocal classes, and the largest share of a worker's last sequence that is padding.
CLASSES, END_PADDING = 64, 0.05
#: Chunks that only the whole tokenizer may split: letters beyond Latin, and what may hold a special token.
_HARD = re.compile(r"[^\x00-\u012f\u0131-\u0233]|<\|")
#: The tokenizer's own split, for lower-case text of the other characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ʯ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ʯ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Known(dict):
    """ids of strings, found by ``learn`` when first asked for; strings of over CACHE_CHARS characters are not kept."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        ids = self.learn(part)
        if len(part) <= CACHE_CHARS:
            self[part] = ids
        return ids


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by a lower-casing tokenizer that drops white space.

    Such a tokenizer treats every white-space-free chunk alone, and every word of a chunk, so the ids of both can be
    remembered. New words go to the tokenizer's model itself, without the normalizing and splitting that they have had.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chunks, self.words = _Known(self._chunk_ids), _Known(self._word_ids)

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word_ids(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        return array("I", [t.id for t in self.model.tokenize(word if plain else word.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        return self._ids(chunk) if _HARD.search(chunk) else b"".join(map(self.words.__getitem__, _WORD.findall(chunk.lower())))

    def encode(self, text: str) -> bytes:
        # str.split() also splits at \x1c-\x1f, which the tokenizer takes for symbols.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._ids(text)
        ids = b"".join(map(self.chunks.__getitem__, text.split()))
        for known, most in ((self.chunks, CACHE_CHUNKS), (self.words, CACHE_WORDS)):
            if len(known) > most:
                known.clear()
        return ids


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this Python worker: Spark hands a worker many tasks, and what it remembers serves them all."""
    return ChunkTokenizer(path)


_idle: list[Timer] = []


def keep_tokenizer(seconds: float | None) -> None:
    """Lets the worker's tokenizer go after so many seconds without another task, so that later stages have its memory; None: a task begins."""
    while _idle:
        _idle.pop().cancel()
    if seconds is not None:
        _idle.append(Timer(seconds, worker_tokenizer.cache_clear))
        _idle[0].daemon = True
        _idle[0].start()


Piece = tuple[int | None, int, bytes, int]  # document, start, ids, tokens of the document


class HarmonicBins:
    """The open bins of one worker, one for each class. add() and close() give the sequences (lists of pieces) that they close."""

    def __init__(self, capacity: int, classes: int = CLASSES, min_piece: int = 8) -> None:
        self.capacity, self.classes, self.least = capacity, min(classes, capacity), min(min_piece, capacity)
        self.open: dict[int, list[Piece]] = {}
        self.short: list[Piece] = []  # a bin with its count of documents and room for a piece of the next one
        self.room = 0

    def _fit(self, length: int) -> int:
        """How much of a length goes into the room: no piece or rest is shorter than the least, but for whole documents."""
        if length <= self.room:
            return length
        return self.room if length - self.room >= self.least else max(0, length - self.least)

    def _fill(self, piece: Piece) -> tuple[Piece | None, list[list[Piece]]]:
        """The rest of a piece after its head has gone into the short bin, and the bin if that closed it."""
        doc, start, ids, total = piece
        take = self._fit(len(ids) // 4)
        if take:
            self.short.append((doc, start, ids[: 4 * take], total))
            self.room -= take
        closed = []
        if take < len(ids) // 4 or self.room < self.least:
            closed, self.short, self.room = [self.short], [], 0
        return ((doc, start + take, ids[4 * take :], total) if 4 * take < len(ids) else None), closed

    def add(self, doc: int | None, ids: bytes) -> list[list[Piece]]:
        piece, out = (doc, 0, ids, len(ids) // 4), []
        if self.short:
            piece, out = self._fill(piece)
        while piece and len(piece[2]) >= 4 * self.capacity:
            doc, start, ids, total = piece
            out.append([(doc, start, ids[: 4 * self.capacity], total)])
            piece = (doc, start + self.capacity, ids[4 * self.capacity :], total)
        if piece and piece[2]:
            count = min(self.capacity // (len(piece[2]) // 4), self.classes)
            bin_ = self.open.setdefault(count, [])
            bin_.append(piece)
            if len(bin_) == count:
                room = self.capacity - sum(len(p[2]) // 4 for p in self.open.pop(count))
                if room < self.least:
                    out.append(bin_)
                else:
                    self.short, self.room = bin_, room
        return out

    def close(self) -> list[list[Piece]]:
        """The pieces of the open bins, end to end; the last sequence as it is where it is nearly full, else as powers of two."""
        pieces, out = [p for _, bin_ in sorted(self.open.items()) for p in bin_], []
        self.open = {}
        for piece in pieces:
            while piece:
                if not self.short:
                    self.room = self.capacity
                piece, closed = self._fill(piece)
                out += closed
        last, self.short = self.short, []
        if not last or self.room <= END_PADDING * self.capacity:
            return out + [last] * bool(last)
        while last:
            size = sum(len(p[2]) // 4 for p in last)
            self.room, head = 1 << (size.bit_length() - 1), []
            while self.room:
                doc, start, ids, total = last.pop(0)
                take = min(self.room, len(ids) // 4)
                head.append((doc, start, ids[: 4 * take], total))
                self.room -= take
                if 4 * take < len(ids):
                    last.insert(0, (doc, start + take, ids[4 * take :], total))
            out.append(head)
        return out


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, eos_id: int = 1, min_piece: int = 8) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null texts count as empty: their document is the end id alone. Every row of df is a document, repeated rows and rows
    without an id included. An empty table gives no rows. Sequence ids are unique over the whole result.
    """
    if capacity < 1 or min_piece < 1:
        raise ValueError("capacity and min_piece must be positive")
    end = int(eos_id).to_bytes(4, "little")
    names = [x.split()[0] for x in PACKED.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_tokenizer(None)
        tokenizer, bins = worker_tokenizer(tokenizer_path), HarmonicBins(capacity, min_piece=min_piece)
        next_id, rows = TaskContext.get().partitionId() * STRIDE, []

        def place(sequences: list[list[Piece]]) -> None:
            nonlocal next_id
            for sequence in sequences:
                offset = 0
                for doc, start, ids, total in sequence:
                    rows.append((doc, start, len(ids) // 4, ids, total, next_id, offset))
                    offset += len(ids) // 4
                next_id += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for got in batches:
            for doc, text in zip(got.column(0), got.column(1), strict=True):
                place(bins.add(doc.as_py(), tokenizer.encode(text.as_py() or "") + end))
                if len(rows) > 4000:
                    yield batch()
        place(bins.close())
        if rows:
            yield batch()
        keep_tokenizer(IDLE_SECONDS)

    own = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, PACKED)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (uint32 bytes, padded to capacity unless n_tokens is a power of two)."""
    piece = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(piece, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    pad = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(capacity - F.col("n_tokens"))
    padding = F.unhex(F.expr(f"repeat('{int(pad_id).to_bytes(4, 'little').hex()}', {capacity})"))
    return one.select("sequence_id", "n_tokens", F.concat("ids", F.substring(padding, F.lit(1), (4 * pad).cast("int"))).alias("ids"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

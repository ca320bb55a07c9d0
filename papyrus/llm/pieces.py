"""Sampled segmentations over the lattice of a SentencePiece vocabulary, and a lossless decoder.

Forward filtering: for every place of a text the total weight of the segmentations that end there. Backward sampling: from
the end, a piece is drawn in proportion to the weight of the segmentations that it closes, then the one before it. Every
segmentation so comes with exactly its share of the weight. The draws come from a generator that is seeded by the row's
key, so a row gets the same segmentation in every run, wherever it is computed.

The vocabulary's merge ranks give the weights (one over the rank; a character without a piece is spelled in byte pieces).
No piece holds a space mark after another character or a line end, so the lattice falls apart there; the distinct parts of
a batch are filtered once, as arrays, and their occurrences are sampled together. Of a long part (text without spaces) only
the totals are kept, twelve bytes a character; what a draw chooses from is made again where the sampling comes by.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Parts up to LONG_CHARS are filtered together as arrays, BLOCK of ARRAY_CHARS at a time or as many fewer as they are longer.
ARRAY_CHARS, LONG_CHARS, BLOCK = 32, 256, 4096
#: Weight of one byte piece.
BYTE_WEIGHT = 1e-6
_BASE, _MULTIPLIERS, _SLOT_BITS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), 20
_U64 = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each unsigned 64-bit number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each seed and step."""
    return (_mixed(seeds + np.uint64(step * 0x632BE59BD9B4E019 & _U64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceSampler:
    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_ids = [0] * 256
        self.plain: list[bytes] = []
        weights: dict[str, tuple[float, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_ids[int(piece[3:5], 16)] = i
                self.plain.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.plain.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses a part's end")
                self.plain.append(piece.replace(SPACE, " ").encode())
                weights[piece] = (1.0 / (2.0 - model.get_score(i)), i)
        for b in range(128):
            weights.setdefault(chr(b), (BYTE_WEIGHT, self.bytes_ids[b]))
        self.weights, self.longest = weights, max(map(len, weights))
        self._index()

    def _index(self) -> None:
        """Two hash tables over the pieces' polynomial hashes; a piece stands in one of its two slots."""
        pieces = list(self.weights)
        self.hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.piece_weights = np.array([self.weights[p][0] for p in pieces] + [0.0])
        self.piece_ids = np.array([self.weights[p][1] for p in pieces] + [-1], np.int64)
        if len(set(self.hashes.tolist())) < len(pieces):
            raise ValueError("two pieces share a hash")
        self.hashes = np.append(self.hashes, np.uint64(0))
        none, size = len(pieces), 1 << _SLOT_BITS
        tables = [[none] * size, [none] * size]
        for k in range(len(pieces)):
            side = 0
            for _ in range(500):
                slot = (int(self.hashes[k]) * _MULTIPLIERS[side] & _U64) >> (64 - _SLOT_BITS)
                k, tables[side][slot] = tables[side][slot], k
                if k == none:
                    break
                side = 1 - side
            else:
                raise ValueError("the hash tables are too small")
        self.tables = [np.array(t, np.int32) for t in tables]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) & _U64
        return h

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, else of the empty entry at the end."""
        out = None
        for table, m in zip(self.tables, _MULTIPLIERS, strict=True):
            at = table[(hashes * np.uint64(m)) >> np.uint64(64 - _SLOT_BITS)]
            at = np.where(self.hashes[at] == hashes, at, len(self.hashes) - 1)
            out = at if out is None else np.minimum(out, at)
        return out

    def _filter(self, parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward filtering of parts of n characters: for each part and end, running shares and ids by piece length (-1: bytes of the character)."""
        codes = np.array(parts, f"<U{n}").view(np.uint32).reshape(len(parts), n).astype(np.uint64)
        prefix = np.zeros((len(parts), n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(_BASE) + codes[:, j] + np.uint64(1)
        most = min(n, self.longest)
        shares, ids = np.zeros((len(parts), n + 1, most)), np.full((len(parts), n + 1, most), -1, np.int32)
        for k in range(1, most + 1):
            at = self._find(prefix[:, k:] - prefix[:, :-k] * np.uint64(pow(_BASE, k, 1 << 64)))
            shares[:, k:, k - 1], ids[:, k:, k - 1] = self.piece_weights[at], self.piece_ids[at]
        raw = np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))
        shares[:, 1:, 0] = np.where(ids[:, 1:, 0] < 0, BYTE_WEIGHT**raw, shares[:, 1:, 0])
        alpha = np.zeros((len(parts), n + 1))
        alpha[:, 0] = 1.0
        for j in range(1, n + 1):
            k = min(j, most)
            shares[:, j, :k] *= alpha[:, j - k : j][:, ::-1]
            np.cumsum(shares[:, j], axis=1, out=shares[:, j])
            alpha[:, j] = shares[:, j, -1]
            shares[:, j] /= alpha[:, j, None]
            if j % 8 == 0:  # only ratios within a piece's reach matter
                alpha[:, max(0, j - most) : j + 1] /= alpha[:, j, None].copy()
        return shares, ids

    def _backward(self, shares: np.ndarray, ids: np.ndarray, which: np.ndarray, seeds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Backward sampling for occurrences ``which`` of the parts: step by step, the occurrences that are still open and their pieces' ids."""
        open_, at, rows, out = np.arange(len(which)), np.full(len(which), shares.shape[1] - 1), [], []
        step = 0
        while len(open_):
            here = shares[which[open_], at]
            k = np.minimum((here <= _uniform(seeds[open_], step)[:, None]).sum(axis=1), shares.shape[2] - 1)
            got = ids[which[open_], at, k].astype(np.int64)
            rows.append(open_)
            out.append(np.where(got < 0, -at, got))
            at = at - k - 1
            open_, at, step = open_[at > 0], at[at > 0], step + 1
        return rows, out

    def _choices(self, part: str, j: int, totals: array, scales: array) -> list[tuple[float, int, int]]:
        """(weight, id or -1, length) of the pieces that end at j, shortest first, each with the segmentations before it; weights in the scale of the last total before j."""
        out = []
        for k in range(1, min(j, self.longest) + 1):
            found = self.weights.get(part[j - k : j])
            if found is None and k == 1:
                found = (BYTE_WEIGHT ** len(part[j - 1].encode("utf-8", "surrogatepass")), -1)
            if found:
                out.append((math.ldexp(found[0] * totals[j - k], scales[j - k] - scales[j - 1]), found[1], k))
        return out

    def _long(self, part: str, seeds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """As _filter and _backward for the occurrences of one long part."""
        totals, scales, n = array("d", [1.0]), array("i", [0]), len(part)
        for j in range(1, n + 1):
            total, scale = sum(w for w, _, _ in self._choices(part, j, totals, scales)), scales[j - 1]
            if total < 2.0**-400:
                total, scale = math.ldexp(total, 400), scale - 400
            totals.append(total)
            scales.append(scale)
        rows, out = [], []
        for r in range(len(seeds)):
            at, step = n, 0
            while at:
                choices = self._choices(part, at, totals, scales)
                left = float(_uniform(seeds[r : r + 1], step)[0]) * sum(w for w, _, _ in choices)
                for w, i, k in choices:
                    left -= w
                    if left < 0:
                        break
                if step == len(rows):
                    rows.append([])
                    out.append([])
                rows[step].append(r)
                out[step].append(-at if i < 0 else i)
                at, step = at - k, step + 1
        return [np.array(r) for r in rows], [np.array(g, np.int64) for g in out]

    def encode_batch(self, texts: list[str], keys: list[object], seed: int = 0) -> list[np.ndarray]:
        """Piece ids of each text; a text's key and the seed fix its draws, whatever else is in the batch."""
        found: dict[str, int] = {}
        flat, sizes, marks = [], [], []
        for text in texts:
            parts = []
            for k, piece in enumerate(text.split(SPACE)) if text else ():
                if k:  # the space mark itself as text: bytes, so that it is not read as a space
                    marks.append(len(flat) + len(parts))
                    parts.append(SPACE)
                parts += _PARTS.findall((SPACE if k == 0 else "") + piece.replace(" ", SPACE))
            flat += parts
            sizes.append(len(parts))
        part_of = np.array([found.setdefault(p, len(found)) for p in flat], np.int64)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key_hash = np.array([zlib.crc32(repr((seed, k)).encode()) for k in keys], np.uint64)
        seeds = _mixed(_mixed(np.repeat(key_hash, sizes) + np.uint64(seed << 32 & _U64)) + number.astype(np.uint64))
        names = list(found)
        lengths = np.array([len(p) for p in names], np.int64)
        order = np.argsort(part_of, kind="stable")
        starts = np.searchsorted(part_of[order], np.arange(len(names) + 1))
        occ, step_no, ids = [], [], []
        special = np.zeros(len(flat), bool)
        special[marks] = True
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            block = 1 if n > LONG_CHARS else BLOCK if n <= ARRAY_CHARS else max(1, BLOCK * ARRAY_CHARS // int(n))
            for lo in range(0, len(own), block):
                some = own[lo : lo + block]
                places = np.concatenate([order[starts[u] : starts[u + 1]] for u in some])
                which = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
                keep = ~special[places]
                places, which = places[keep], which[keep]
                shares, table = self._filter([names[u] for u in some], int(n)) if n <= LONG_CHARS else (None, None)
                for at in range(0, len(places), 1 << 16 if n <= LONG_CHARS else max(1, len(places))):
                    rows, got = self._long(names[some[0]], seeds[places]) if n > LONG_CHARS else self._backward(shares, table, which[at : at + (1 << 16)], seeds[places[at : at + (1 << 16)]])
                    for step, (r, g) in enumerate(zip(rows, got, strict=True)):
                        occ.append(places[at : at + (1 << 16)][r])
                        step_no.append(np.full(len(r), step))
                        ids.append(g)
        for m in marks:
            occ.append(np.array([m]))
            step_no.append(np.array([0]))
            ids.append(np.array([-1]))
        if not occ:
            return [np.zeros(0, np.int64) for _ in texts]
        occ, step_no, ids = np.concatenate(occ), np.concatenate(step_no), np.concatenate(ids)
        counts = np.bincount(occ, minlength=len(flat))
        ends = np.cumsum(counts)
        out = np.empty(len(ids), np.int64)
        out[ends[occ] - 1 - step_no] = ids
        own_part = np.repeat(np.arange(len(flat)), counts)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=counts, minlength=len(texts)).astype(np.int64))))
        result = []
        for t in range(len(texts)):
            got = out[bounds[t] : bounds[t + 1]]
            low = np.flatnonzero(got < 0)  # characters without a piece, by their end within the part
            if len(low):
                pieces, last = [], 0
                for i in low:
                    char = flat[own_part[bounds[t] + i]][-got[i] - 1]
                    pieces += [got[last:i], np.array([self.bytes_ids[b] for b in char.encode("utf-8", "surrogatepass")])]
                    last = i + 1
                got = np.concatenate([*pieces, got[last:]])
            result.append(got)
        return result

    def encode(self, text: str, key: object, seed: int = 0) -> list[int]:
        return self.encode_batch([text], [key], seed)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that the ids were made from: exactly, whatever was drawn."""
        plain = self.plain
        return b"".join([plain[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Characters of texts that are sampled together.
BATCH_CHARS = 4_000_000


def bounded_slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``most`` characters together; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if len(texts) > lo:
        yield lo, len(texts)


ENCODED = "doc_id long, n_pieces long, ids binary, lossless boolean"


def sample_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """ENCODED for every row of df: ids as little-endian uint32, lossless whether decoding gave the text back.

    The key of a row is its id (null ids share one). Null and empty texts have no pieces. Repeated rows get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler(model)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in bounded_slices(texts, BATCH_CHARS):
                found = sampler.encode_batch(texts[lo:hi], docs[lo:hi], seed)
                same = [sampler.decode(ids.tolist()) == t for ids, t in zip(found, texts[lo:hi], strict=True)]
                raw = [ids.astype("<u4").tobytes() for ids in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int64()), pa.array(raw, pa.binary()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "lossless"])

    own = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, ENCODED)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from sample_pieces()'s ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler(model)
        for batch in batches:
            texts = [sampler.decode(np.frombuffer(raw or b"", "<u4").tolist()) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(df, doc_id=id_col, ids=ids_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, text string")

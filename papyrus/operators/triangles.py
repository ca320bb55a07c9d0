"""Triangles of a graph, counted by arrays: nodes get one of c colours, and the triangles of three colours are one task's.

An edge goes to the c tasks whose colours hold both of its ends', packed (sorted, as differences, compressed) before it is copied. There are as
many colours as it takes for a task to hold EDGES edges or so, and the copies grow with the root of the edges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task holds, edges that are packed together, bytes of a table of bits, entries of a step.
EDGES, PACKED, BITS, STEP = 1_500_000, 1_000_000, 1 << 28, 1 << 22


def colours_for(edges: int) -> int:
    """A task holds three pairs of colours, each of 2 / c^2 of the edges."""
    return max(1, math.ceil(math.sqrt(6 * edges / EDGES)))


def colour(nodes: np.ndarray, c: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(c)).astype(np.int64)


def pack(a: np.ndarray, b: np.ndarray) -> bytes:
    """Edges in the order of a, then b."""
    return zlib.compress(np.concatenate([np.diff(a, prepend=0), np.diff(b, prepend=0)]).astype("<i8").tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zlib.decompress(blob), "<i8")
    return np.cumsum(flat[: len(flat) // 2]), np.cumsum(flat[len(flat) // 2 :])


def _dealt(batches: Iterator[pa.RecordBatch], c: int) -> Iterator[pa.RecordBatch]:
    """(p, q, edges): packed edges whose ends have colours p <= q, in that order."""
    held, n = [], 0

    def give() -> pa.RecordBatch:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        swap = (colour(a, c) > colour(b, c)) | ((colour(a, c) == colour(b, c)) & (a > b))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        pair = colour(a, c) * c + colour(b, c)
        order = np.lexsort((b, a, pair))
        a, b, pair = a[order], b[order], pair[order]
        cuts = np.flatnonzero(np.diff(pair)) + 1
        starts = np.append(0, cuts)
        blobs = [pack(x, y) for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((pair[starts] // c).astype(np.int32)), pa.array((pair[starts] % c).astype(np.int32)), pa.array(blobs, pa.binary())], ["p", "q", "edges"])

    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        n += batch.num_rows
        if n >= PACKED:
            yield give()
            held, n = [], 0
    if n:
        yield give()


class _Lists:
    """Of n nodes the neighbours among m others, as sorted pairs and, where it fits, as bits."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int, m: int) -> None:
        self.m, self.keys = m, np.unique(a * m + b)
        self.start = np.searchsorted(self.keys, np.arange(n + 1) * m)
        self.degree, self.near, self.bits = np.diff(self.start), self.keys % m, None

    def table(self) -> np.ndarray:
        if self.bits is None:
            words = -(-self.m // 64)
            raw = np.zeros((len(self.degree), words * 8), np.uint8)
            rows = self.keys // self.m
            np.bitwise_or.at(raw, (rows, self.near >> 3), (1 << (self.near & 7)).astype(np.uint8))
            self.bits = raw.view(np.uint64)
        return self.bits


def common(u: np.ndarray, v: np.ndarray, left: _Lists, right: _Lists) -> np.ndarray:
    """How many neighbours each u[k] (left) and v[k] (right) have in common."""
    out = np.zeros(len(u), np.int64)
    fewer = np.minimum(left.degree[u], right.degree[v])
    words = -(-left.m // 64)
    if (len(left.degree) + len(right.degree)) * words * 8 <= BITS and len(u) * words < 8 * int(fewer.sum()):
        x, y, step = left.table(), right.table(), max(1, STEP // max(1, words))
        for lo in range(0, len(u), step):
            out[lo : lo + step] = np.bitwise_count(x[u[lo : lo + step]] & y[v[lo : lo + step]]).sum(axis=1, dtype=np.int64)
        return out
    # The shorter list of the two is looked up in the other one.
    for mine, own, theirs, other, some in ((left, u, right, v, left.degree[u] <= right.degree[v]), (right, v, left, u, left.degree[u] > right.degree[v])):
        at = np.flatnonzero(some & (fewer > 0))
        ends = np.cumsum(fewer[at])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP)))
            k, many = at[lo:hi], fewer[at[lo:hi]]
            place = np.arange(int(many.sum())) + np.repeat(mine.start[own[k]] - (np.cumsum(many) - many), many)
            wanted = np.repeat(other[k], many) * theirs.m + mine.near[place]
            found = np.minimum(np.searchsorted(theirs.keys, wanted), len(theirs.keys) - 1)
            out[k] = np.add.reduceat((theirs.keys[found] == wanted).astype(np.int64), np.cumsum(many) - many)
            lo = hi
    return out


def of_colours(pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], i: int, j: int, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """colour -> (nodes, triangles of each whose corners have the colours i <= j <= k). pairs: (p, q), p <= q -> edges (a of colour p, b of colour q)."""
    names: dict[int, np.ndarray] = {}
    for c in {i, j, k}:
        names[c] = np.unique(np.concatenate([np.zeros(0, np.int64)] + [e[s] for (p, q), e in pairs.items() for s, d in ((0, p), (1, q)) if d == c]))
    local = {(p, q): (np.searchsorted(names[p], a), np.searchsorted(names[q], b)) for (p, q), (a, b) in pairs.items()}
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = {c: np.zeros(len(names[c])) for c in names}
    lists: dict[tuple[int, int], _Lists] = {}

    def near(p: int, q: int) -> _Lists:
        """The neighbours of colour q of the nodes of colour p."""
        if (p, q) not in lists:
            a, b = local.get((min(p, q), max(p, q)), none)
            a, b = (np.concatenate([a, b]), np.concatenate([b, a])) if p == q else (a, b) if p < q else (b, a)
            lists[p, q] = _Lists(a, b, len(names[p]), max(1, len(names[q])))
        return lists[p, q]

    def closed(p: int, q: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v = local.get((p, q), none)
        return u, v, common(u, v, near(p, r), near(q, r)) if len(u) else np.zeros(0, np.int64)

    def add(c: int, at: np.ndarray, n: np.ndarray) -> None:
        total[c] += np.bincount(at, n, len(total[c]))

    if i == k:
        u, v, t = closed(i, i, i)
        add(i, u, t / 2), add(i, v, t / 2)
    elif i == j or j == k:
        two, other = (i, k) if i == j else (k, i)
        u, v, t = closed(two, two, other)
        add(two, u, t), add(two, v, t)
        u, v, t = closed(i, k, two)
        add(other, v if other == k else u, t / 2)
    else:
        u, v, t = closed(i, j, k)
        add(i, u, t), add(j, v, t)
        _, v, t = closed(j, k, i)
        add(k, v, t)
    return {c: (names[c][total[c] > 0], np.rint(total[c][total[c] > 0]).astype(np.int64)) for c in names}


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) of nodes with any; edges (src, dst; each pair once, no loops), which are read twice."""
    c = colours_for(edges.count())
    packed = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(lambda batches: _dealt(batches, c), "p int, q int, edges binary")
    three = F.array_sort(F.array("p", "q", "r"))
    sent = packed.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(c - 1)))).withColumn("three", three)
    keyed = sent.select("p", "q", "edges", *[F.get("three", k).alias(n) for k, n in enumerate("ijk")])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = {}
        for (p, q), own in rows.groupby(["p", "q"]):
            found = [unpack(blob) for blob in own["edges"]]
            pairs[int(p), int(q)] = tuple(np.concatenate([f[s] for f in found]) for s in (0, 1))
        found = of_colours(pairs, *(int(rows[n].iloc[0]) for n in "ijk")).values()
        return pd.DataFrame({"node": np.concatenate([n for n, _ in found]), "n": np.concatenate([n for _, n in found])})

    tasks = min(c * (c + 1) * (c + 2) // 6, 2000)
    counted = keyed.repartition(tasks, "i", "j", "k").groupBy("i", "j", "k").applyInPandas(run, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("triangles"))

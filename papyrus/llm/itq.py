"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the vectors' principal components is learned so that their signs are balanced bits which lose little (iterative
quantisation: the codes nearest to the rotated vectors, then the rotation nearest to the codes, by turns). A few rotations
from other starts give more bits. The bits are cut into ``TABLES`` substrings, as wide as the number of vectors asks for, so that
unrelated vectors seldom share one; a vector also probes the substrings that differ from its own where it lies nearest to
the other sign. Pairs that meet in a table and whose codes differ in few bits are compared by their original vectors.

Equal vectors are one vertex. Dense groups do not become all their pairs: each vertex is first linked to the first one of its
buckets, and only members of different groups meet after that; in a bucket where one group has more members than any other,
the others meet it, but it does not meet itself. So components of links are found from about as many pairs as vertices. The number of
links of a vertex is counted within its component: what lies so near to a large component's centroid that it must be linked with
every member (the angles to the centroid add up to less than the threshold's) is counted without comparing; the rest of it, and
small components whole, meet block by block. So within a component no link is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import checkpointed, pick
from papyrus.operators.graph import label_components

#: Vectors that the rotation is learned from, at most (those with the smallest hashes); the only use of a sample.
FIT_ROWS = 20_000
TABLES, PROBES, ROTATIONS_STEPS = 6, 6, 30
#: Width of a table's substring: as many bits as number the vectors, within these bounds.
LEAST_BITS, MOST_BITS, CODE = 12, 21, 64
#: Rows of a block of a component; buckets and components of more are large ones.
BLOCK_ROWS, LARGE_BUCKET = 1024, 64
#: The sets of bits that are flipped, by their rank from the least certain one on.
FLIPS = ((0,), (1,), (2,), (0, 1), (3,), (0, 2), (4,), (1, 2), (5,))


class Quantiser:
    """Mean, principal axes and rotations; bits and probes of vectors."""

    def __init__(self, sample: np.ndarray, rows: int, tables: int = TABLES, probes: int = PROBES, seed: int = 42) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.mean = sample.mean(axis=0)
        axes = np.linalg.svd(sample - self.mean, full_matrices=True)[2] if len(sample) < dim else np.linalg.eigh((sample - self.mean).T @ (sample - self.mean))[1].T[::-1]
        axes = axes[: min(dim, CODE)]
        self.bits = len(axes)
        self.width = min(max(LEAST_BITS, math.ceil(math.log2(max(2, rows)))), MOST_BITS, self.bits)
        self.tables, self.each = tables, self.bits // self.width
        self.flips = [f for f in FLIPS if max(f) < self.width][:probes]
        parts = (sample - self.mean) @ axes.T
        self.maps = [axes.T @ self._rotation(parts, rng) for _ in range(-(-tables // self.each))]

    @staticmethod
    def _rotation(parts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        turn = np.linalg.qr(rng.normal(size=(parts.shape[1],) * 2))[0]
        for _ in range(ROTATIONS_STEPS):
            left, _, right = np.linalg.svd(parts.T @ np.where(parts @ turn > 0, 1.0, -1.0))
            turn = left @ right
        return turn

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of CODE bits, own keys, probed keys) of unit vectors; a key is a table's number and substring."""
        code, own, probes = None, [], []
        weights = 1 << np.arange(self.width, dtype=np.int64)
        for k, turn in enumerate(self.maps):
            at = (unit - self.mean) @ turn
            if k == 0:
                padded = np.zeros((len(unit), CODE), dtype=np.uint8)
                padded[:, : self.bits] = at > 0
                code = np.packbits(padded, axis=1, bitorder="little").view("<i8")[:, 0]
            for j in range(min(self.each, self.tables - k * self.each)):
                part = at[:, j * self.width : (j + 1) * self.width]
                key = ((k * self.each + j) << (MOST_BITS + 1)) + (part > 0) @ weights
                own.append(key)
                flip = weights[np.argsort(np.abs(part), axis=1)[:, :6]]
                probes += [key ^ flip[:, list(f)].sum(axis=1) for f in self.flips]
        return code, np.stack(own, axis=1).astype(np.int32), np.stack(probes, axis=1).astype(np.int32)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in doubles; all lists have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _with_cosine(df: DataFrame, x: str, y: str) -> DataFrame:
    """df without its vectors x and y but with their cosine, in double precision; -1 where one of them is zero."""
    rest = [c for c in df.columns if c not in (x, y)]
    schema = df.select(*rest).withColumn("cosine", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with np.errstate(invalid="ignore", divide="ignore"):
                    found = np.einsum("ij,ij->i", _matrix(batch.column(batch.schema.get_field_index(x))), _matrix(batch.column(batch.schema.get_field_index(y))))
                kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.nan_to_num(found, nan=-1.0))], [*rest, "cosine"])

    return df.mapInArrow(run, schema)


def most_bits_off(threshold: float) -> int:
    """Of CODE bits, how many differ between vectors at the threshold: the mean and three deviations of independent bits."""
    share = math.acos(threshold) / math.pi
    return math.ceil(CODE * share + 3 * math.sqrt(CODE * share * (1 - share)))


def _verified(pairs: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose original vectors reach the threshold."""
    full = pairs.join(vertices.select(F.col("vertex").alias("a"), F.col("v").alias("va")), ["a"]).join(vertices.select(F.col("vertex").alias("b"), F.col("v").alias("vb")), ["b"])
    return _with_cosine(full, "va", "vb").where(F.col("cosine") >= threshold).select("a", "b")


def first_links(coded: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): each vertex with the first one of its buckets whose code is near, where the vectors reach the threshold."""
    own = coded.select("vertex", "code", F.explode("own").alias("key"))
    heads = own.groupBy("key").agg(F.min("vertex").alias("head"), F.min_by("code", "vertex").alias("head_code"))
    near = own.join(heads, ["key"]).where((F.col("head") < F.col("vertex")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("head_code"))) <= most_bits_off(threshold)))
    return _verified(near.groupBy(F.col("vertex").alias("b")).agg(F.min("head").alias("a")), vertices, threshold).toDF("src", "dst")


def other_links(coded: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): pairs of different groups that meet in a table and reach the threshold. coded has grp."""
    own = coded.select("vertex", "grp", "code", F.explode("own").alias("key"))
    probe = coded.select("vertex", "grp", "code", F.explode("probes").alias("key"))
    # Of large buckets, the group with most members: it meets the others, not itself.
    members = own.groupBy("key", "grp").agg(F.count("*").alias("n"))
    main = members.groupBy("key").agg(F.sum("n").alias("rows"), F.max_by("grp", "n").alias("main")).where(F.col("rows") > LARGE_BUCKET).select("key", "main")
    right = own.join(main, ["key"], "left").select("key", F.coalesce(F.col("grp") == F.col("main"), F.lit(False)).alias("of_main"), F.col("vertex").alias("b"), F.col("grp").alias("b_grp"), F.col("code").alias("b_code"))
    left = own.withColumn("probed", F.lit(False)).unionByName(probe.withColumn("probed", F.lit(True))).join(main, ["key"], "left")
    meets = F.when(F.col("main").isNull() | (F.col("grp") == F.col("main")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    left = left.select("key", F.explode(meets).alias("of_main"), F.col("vertex").alias("a"), F.col("grp").alias("a_grp"), F.col("code").alias("a_code"))
    near = (F.col("a_grp") != F.col("b_grp")) & (F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) <= most_bits_off(threshold))
    met = left.join(right, ["key", "of_main"]).where(near)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(pairs, vertices, threshold).toDF("src", "dst")


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(vertex, linked): the weights of the other vertices of a component that each is linked with. members: vertex, component, size, w (its weight), v."""
    size = F.col("size") > BLOCK_ROWS
    large = members.where(size)
    unit = lambda df: df.withColumn("u", array_to_vector(F.transform("v", lambda x: x.cast("double"))))
    centre = unit(large).groupBy("component").agg(Summarizer.mean(F.col("u")).alias("m")).select("component", vector_to_array("m").alias("m"))
    angle = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    turned = _with_cosine(large.select("component", "vertex", "w", "v").join(centre, ["component"]), "v", "m").select("component", "vertex", "w", angle.alias("angle"))
    widest = turned.groupBy("component").agg(F.max("angle").alias("widest"))
    turned = checkpointed(turned.join(widest, ["component"]).select("component", "vertex", "w", (F.col("angle") + F.col("widest") <= math.acos(threshold) - 1e-6).alias("inner")))
    totals = turned.groupBy("component").agg(F.sum("w").alias("all_w"), F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0)).alias("inner_w"), F.count_if(~F.col("inner")).alias("outer"))
    known = turned.select("component", "vertex", "w", "inner").join(totals, ["component"]).select("vertex", F.when(F.col("inner"), F.col("all_w") - F.col("w")).otherwise(F.col("inner_w")).alias("linked"))
    blocks = F.ceil(F.col("outer") / BLOCK_ROWS).cast("int")
    rest = turned.where(~F.col("inner")).join(totals.select("component", "outer"), ["component"]).join(large.select("vertex", "v"), ["vertex"]).select("component", "vertex", "w", "v", blocks.alias("blocks"))
    every = members.where(~size).select("component", "vertex", "w", "v", F.lit(1).alias("blocks")).unionByName(rest)
    blk = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("lo"), F.greatest("blk", o).alias("hi")))
    met = every.withColumn("blk", blk).select("component", "vertex", "w", "v", "blk", F.explode(others).alias("at")).select("component", "at.lo", "at.hi", "blk", "vertex", "w", "v")
    dealt = met.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "blk")

    def compare(ids: np.ndarray, w: np.ndarray, x: np.ndarray, first: int) -> np.ndarray:
        """Weights that each of the rows of two blocks (the second from ``first`` on; none: one block) is linked with."""
        if first in (0, len(ids)):
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            return near @ w
        near = x[:first] @ x[first:].T >= threshold
        return np.concatenate([near @ w[first:], near.T @ w[:first]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of one group: blk, ids, weights, vectors
        now: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                blk, ids, w, x = (np.concatenate([h[k] for h in held]) for k in range(4))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(compare(ids, w, x, int((blk == blk[0]).sum()) if now[1] != now[2] else 0))], ["vertex", "linked"])

        for batch in batches:
            if not batch.num_rows:
                continue
            component, lo, hi, blk, ids, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            x = _matrix(batch.column(6))
            new = (component[1:] != component[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                key = (component[a], lo[a], hi[a])
                if key != now:
                    yield from close()
                    now = key
                if 0 < k and b < batch.num_rows and key[1] == key[2]:  # a whole group, as most are
                    done.append((ids[a:b], compare(ids[a:b], w[a:b], x[a:b], 0)))
                else:
                    held.append((blk[a:b], ids[a:b], w[a:b], x[a:b]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], ["vertex", "linked"])
        yield from close()

    met = dealt.mapInArrow(run, "vertex long, linked long")
    return met.unionByName(known).groupBy("vertex").agg(F.sum("linked").alias("linked"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    Linked are vectors whose cosine, in double precision, is at least ``threshold`` (between 0 and 1); n_links counts the other rows that a row is linked
    with, component_id is the smallest vec_id that links reach, its own included, kept says that the row has that id (rows without
    an id are kept and name no component). Vectors that are null, empty or zero, hold null or non-finite components, or have
    another length than most (ties: the longest) link with nothing. Repeated rows are linked with each other.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    own = pick(df, vec_id=id_col, v=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # Two hashes of 64 bits stand for a vector; -0.0 counts as 0.0. The second begins with another seed.
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(df.schema[vector_col].dataType.elementType))
    own = own.select("vec_id", "v", F.when(sound, F.size("v")).alias("dim"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"))
    dims = own.where("dim is not null").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()  # one row

    def alone(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    if not dims:
        return alone(own)
    good = F.coalesce(F.col("dim") == dims[0]["dim"], F.lit(False))
    sole = own.where(good).groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    vertices = checkpointed(sole.withColumn("vertex", F.monotonically_increasing_id()))
    rows = vertices.count()
    fit = vertices.orderBy("h1", "h2").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    coder = Quantiser(_matrix(fit), rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, own_keys, probes = coder.codes(_matrix(batch.column(1)))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(k.reshape(-1)), k.shape[1]).cast(pa.list_(pa.int32())) for k in (own_keys, probes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *lists], ["vertex", "code", "own", "probes"])

    coded = vertices.select("vertex", "v").mapInArrow(code, "vertex long, code long, own array<int>, probes array<int>")
    first = checkpointed(first_links(coded, vertices, threshold))
    groups = checkpointed(label_components(first)).toDF("vertex", "grp")
    named = coded.join(groups, ["vertex"], "left").withColumn("grp", F.coalesce("grp", "vertex"))
    more = checkpointed(other_links(named, vertices, threshold))
    of = lambda end: groups.select(F.col("vertex").alias(end), F.col("grp").alias(f"{end}_grp"))
    between = more.join(of("src"), ["src"], "left").join(of("dst"), ["dst"], "left").select(F.coalesce("src_grp", "src").alias("src"), F.coalesce("dst_grp", "dst").alias("dst")).distinct()
    merged = label_components(between).toDF("grp", "merged")
    # Vertices in no pair of groups keep their group; those in no group have no link.
    ends = groups.unionByName(more.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().join(groups.select("vertex"), ["vertex"], "left_anti").withColumn("grp", F.col("vertex")))
    labelled = checkpointed(ends.join(merged, ["grp"], "left").select("vertex", F.coalesce("merged", "grp").alias("component")))
    members = labelled.join(vertices.select("vertex", "first_id", F.col("n").alias("w"), "v"), ["vertex"])
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.min("first_id").alias("component_id"))
    linked = _counted(members.join(sizes.select("component", "size"), ["component"]).select("vertex", "component", "size", "w", "v"), threshold)
    done = linked.join(labelled, ["vertex"]).join(sizes.select("component", "component_id"), ["component"]).select("vertex", "linked", "component_id")
    facts = vertices.select("vertex", "h1", "h2", "first_id", "n").join(done, ["vertex"], "left").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("linked").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull())
    found = own.where(good).select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id", kept.alias("kept"))
    return found.unionByName(alone(own.where(~good)))

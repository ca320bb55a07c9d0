"""Linked vectors against all pairs in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from papyrus.llm import itq
from papyrus.llm.queries import op12_itq_neighbours


def brute(ids: list, x: np.ndarray, threshold: float = 0.95) -> dict:
    """place -> (links, component id, kept) of rows with distinct ids."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    first = {c: min(ids[k] for k in np.flatnonzero(label == c)) for c in set(label.tolist())}
    return {ids[k]: (int(near[k].sum()), first[label[k]], ids[k] == first[label[k]]) for k in range(len(ids))}


def turned(rng: np.random.Generator, x: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Vectors with the given cosines to x."""
    e = rng.normal(size=x.shape)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    e -= (e * x).sum(axis=1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    return cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * e


def frame(spark, ids, x):
    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([v.tolist() for v in x], pa.list_(pa.float64()))}))


def as_dict(df) -> dict:
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = op12_itq_neighbours(spark, sf_dir)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert as_dict(found) == brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64))


def test_recall_at_the_threshold_itself(spark):
    """Pairs from 0.93 to 0.99 and chains of them: no false link, over 0.97 of the true ones, all of those at 0.98."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    y = turned(rng, x, rng.uniform(0.93, 0.99, 3000))
    z = turned(rng, y, rng.uniform(0.95, 0.99, 3000))
    all_, ids = np.concatenate([x, y, z * 7]), list(range(9000))
    want, got = brute(ids, all_), as_dict(itq.near_duplicates(frame(spark, ids, all_)))
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    near = turned(rng, x, np.full(3000, 0.98))
    got = as_dict(itq.near_duplicates(frame(spark, list(range(6000)), np.concatenate([x, near]))))
    assert np.mean([got[i][1] == i == got[i + 3000][1] for i in range(3000)]) > 0.995


def test_large_groups_are_counted_exactly(spark, monkeypatch):
    """A tight cloud, whose links the centroid tells, one as wide as the threshold, and copies with many rows."""
    monkeypatch.setattr(itq, "BLOCK_ROWS", 64)
    monkeypatch.setattr(itq, "LARGE_BUCKET", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 48))
    tight = turned(rng, np.repeat(centres[:1], 400, axis=0), np.full(400, 0.995))
    wide = turned(rng, np.repeat(centres[1:2], 500, axis=0), rng.uniform(0.96, 0.999, 500))
    same = np.repeat(centres[2:], 300, axis=0)
    x = np.concatenate([tight, wide, same, rng.normal(size=(400, 48))])
    ids = rng.permutation(len(x)).tolist()
    want, got = brute(ids, x), as_dict(itq.near_duplicates(frame(spark, ids, x)))
    assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [2.0, 0.0, -0.0]), (None, [1.0, 0.0, 0.0]), (9, [0.0, 1e200, 0.0]), (10, [1e-200, 1e200, 0.0]), (11, [1.0, 0.0]), (8, [2.0, 0.0, 0.0]), (2, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, h1 long, code string")
    got = sorted((tuple(r) for r in itq.near_duplicates(df).collect()), key=repr)
    linked = {1: 3, 8: 3, None: 3, 9: 1, 10: 1}
    first = {1: 1, 8: 1, None: 1, 9: 9, 10: 9}
    want = sorted(((i, linked.get(i, 0), first.get(i, i), i is None or first.get(i, i) == i) for i, _ in rows), key=repr)
    assert got == want
    assert itq.near_duplicates(df.limit(0)).count() == 0
    assert itq.near_duplicates(df.where("vec_id = 2")).collect()[0]["kept"]
    with pytest.raises(ValueError):
        itq.near_duplicates(df, threshold=1.5)


def test_bits_are_balanced_and_probes_differ_from_keys():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 20)) * np.linspace(3, 0.2, 20) + 5
    x /= np.linalg.norm(x, axis=1)[:, None]
    coder = itq.Quantiser(x, 5000)
    code, own, probes = coder.codes(x)
    assert own.shape == (2000, itq.TABLES) and probes.shape == (2000, itq.TABLES * itq.PROBES)
    bits = np.unpackbits(code.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : coder.bits].mean(axis=0)
    assert (abs(bits - 0.5) < 0.15).all()
    assert (np.repeat(own, itq.PROBES, axis=1) != probes).all() and (np.repeat(own, itq.PROBES, axis=1) >> 22 == probes >> 22).all()

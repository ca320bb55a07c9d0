from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from papyrus.llm import queries, simhash
from papyrus.operators.graph import label_components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """doc_id -> fingerprint to doc_id -> smallest doc_id reached."""
    name = {d: d for d in fps}

    def find(d):
        while name[d] != d:
            d = name[d]
        return d

    docs = list(fps)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                name[y] = x
    return {d: find(d) for d in docs}


def test_query_by_brute_force(spark, sf_dir, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    names = brute_components(fps)
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_simhash_pigeonring(spark, sf_dir).collect()}
    assert found == {d: (f"{fps[d]:016x}", names[d]) for d in texts}
    assert len(set(names.values())) < len(names)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_clouds_by_brute_force(spark):
    """Clouds around a few centres: every pair within four bits is linked, no other."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(200)})
    table = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "fp long, grp long")
    pairs = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert {frozenset(r) for r in simhash.near_links(table, 4).collect()} == pairs
    ones = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() == 1}
    assert {frozenset(r) for r in simhash.close_links(table).collect()} == ones


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 501 + k) for k in range(50)] + [(900, 900), (-5, 700), (700, -5)]
    found = dict(label_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert found == {k: 0 for k in range(101)} | {k: 500 for k in range(500, 551)} | {-5: -5, 700: -5}
    assert label_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect())
    assert ids == [-7, 1, 4, 5, 6]
    assert kept.where(F.col("doc_id").isNull()).count() == 1


def test_a_cloud_in_one_key_does_not_become_its_pairs(spark):
    """Fingerprints two bits from a centre, most of them in one key and none one bit apart: few links are made, one component is found."""
    centre = 0x0F1E2D3C4B5A6978
    cloud = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})
    strays = [centre ^ 0b111 ^ (0b111 << 40), ~centre & ((1 << 63) - 1)]
    rows = [(simhash._signed(x), simhash._signed(x)) for x in cloud + strays]
    vertices = spark.createDataFrame(rows, "fp long, grp long")
    heads = simhash.head_links(vertices, 4)
    assert heads.count() <= 5 * len(rows)
    label = {r["node"]: r["component"] for r in simhash.label_components(heads).collect()}
    grouped = spark.createDataFrame([(fp, label.get(fp, fp)) for fp, _ in rows], "fp long, grp long")
    links = simhash.near_links(grouped, 4).collect()
    assert len(links) < 40 * len(rows)  # all pairs would be two million
    parent = dict(label)
    top = {fp: parent.get(fp, fp) for fp, _ in rows}
    for r in links:
        a, b = top[r["src"]], top[r["dst"]]
        if a != b:
            top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
    assert len({top[simhash._signed(x)] for x in cloud}) == 1
    assert all((a ^ b).bit_count() <= 4 for r in links for a, b in [(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1)])

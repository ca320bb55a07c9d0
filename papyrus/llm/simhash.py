"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

A fingerprint has 64 bits. Two texts link when their fingerprints differ in at most ``tau`` bits. With the bits laid out on
a ring of ``tau + 1`` segments, the differences of a linked pair add up to at most tau, so somewhere on the ring starts a
chain whose first l segments together differ in at most ``floor(l * tau / (tau + 1))`` bits, for every l: 0 bits in the
first segment, at most 1 in the first two, at most 2 in the first three, and so on (the pigeonring principle). The first
two conditions are an equality on a 26-bit key (each fingerprint also probes the keys with one zero bit of the second
segment set), the longer chains are checked on the candidates of a key, and only what passes them gets the full test.

Exact copies share a fingerprint and are one vertex, however many there are. Fingerprints one bit apart, and each fingerprint
with the first of every key that it has, are joined first; after that only members of different groups meet as candidates, and the
largest group of a crowded key does not meet itself. So a dense cloud of near copies does not become all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import checkpointed, pick
from papyrus.operators.graph import label_components

BITS = 64
SEED = 42
#: Shingles that one pass over a text turns into bits at a time; bounds memory on very long texts.
BLOCK = 1 << 16
#: A fingerprint of more than one in so many rows is joined by broadcast, so there are fewer than so many of them.
HOT_SHARE = 1000
SALTS = 16
#: Fingerprints of an index key from which its largest group does not meet itself.
LARGE_KEY = 64


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 for a text without words (or null)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the white space \x20 \x09-\x0d
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), BLOCK):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[lo : lo + BLOCK], ends[lo : lo + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of df; fp is a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    own = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _ring(tau: int) -> list[tuple[int, int]]:
    """(shift, width) of each of the tau + 1 segments."""
    m = tau + 1
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain_masks(tau: int, length: int) -> list[int]:
    """For each start on the ring, the bits of the chain of that many segments."""
    ring = _ring(tau)
    return [sum(((1 << w) - 1) << s for s, w in (ring[(k + j) % len(ring)] for j in range(length))) for k in range(len(ring))]


def _keys(fp: Column, tau: int) -> tuple[list[Column], list[Column]]:
    """Index keys of a fingerprint (one for each start), and probe keys (one for each zero bit, else null)."""
    ring, own, probes = _ring(tau), [], []
    for k, (shift, width) in enumerate(ring):
        next_shift, next_width = ring[(k + 1) % len(ring)]
        first = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned(fp, next_shift).bitwiseAND(F.lit((1 << next_width) - 1))
        key = F.lit(k << 40) + F.shiftleft(first, next_width) + second
        own.append(key)
        probes += [F.when(F.shiftrightunsigned(fp, next_shift + b).bitwiseAND(F.lit(1)) == 0, key + F.lit(1 << b)) for b in range(next_width)]
    return own, probes


def head_links(vertices: DataFrame, tau: int) -> DataFrame:
    """(src, dst): each fingerprint with the smallest one of every index key that it has, where they differ in at most tau bits. A cloud whose members share a key so becomes one group by as many links as members."""
    own = vertices.select(F.col("fp").alias("dst"), F.explode(F.array(*_keys(F.col("fp"), tau)[0])).alias("key"))
    heads = own.groupBy("key").agg(F.min("dst").alias("src"))
    return own.join(heads, ["key"]).where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= tau)).select("src", "dst").distinct()


def near_links(vertices: DataFrame, tau: int) -> DataFrame:
    """(src, dst): fingerprints of different groups that differ in at most tau bits. vertices: fp (unique), grp.

    In an index key with more than LARGE_KEY fingerprints the group with most of them meets the others, but not itself: so a key that a
    cloud fills costs its members times those of other groups, not their square.
    """
    if not 1 <= tau <= 7:
        raise ValueError("tau must be from 1 to 7")
    own, probes = _keys(F.col("fp"), tau)
    index = vertices.select("fp", "grp", F.explode(F.array(*own)).alias("key"))
    members = index.groupBy("key", "grp").agg(F.count("*").alias("n"))
    main = members.groupBy("key").agg(F.sum("n").alias("rows"), F.max_by("grp", "n").alias("main")).where(F.col("rows") > LARGE_KEY).select("key", "main")
    probe = vertices.select("fp", "grp", F.explode(F.array_compact(F.array(*probes))).alias("key"))
    both = index.withColumn("flipped", F.lit(False)).unionByName(probe.withColumn("flipped", F.lit(True))).join(main, ["key"], "left")
    meets = F.when(F.col("main").isNull() | (F.col("grp") == F.col("main")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    left = both.select(F.col("fp").alias("a"), F.col("grp").alias("a_grp"), "flipped", "key", F.explode(meets).alias("of_main"))
    right = index.join(main, ["key"], "left").select(F.col("fp").alias("b"), F.col("grp").alias("b_grp"), "key", F.coalesce(F.col("grp") == F.col("main"), F.lit(False)).alias("of_main"))
    differ, start = F.col("a").bitwiseXOR(F.col("b")), (F.shiftright("key", 40) + 1).cast("int")
    hit = F.col("a_grp") != F.col("b_grp")
    for length in range(3, tau + 1):
        masks = F.array(*[F.lit(_signed(m)) for m in _chain_masks(tau, length)])
        hit &= F.bit_count(differ.bitwiseAND(F.element_at(masks, start))) <= length * tau // (tau + 1)
    hit &= F.bit_count(differ) <= tau
    found = left.join(right, ["key", "of_main"]).where(hit)
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def close_links(vertices: DataFrame) -> DataFrame:
    """(src, dst): fingerprints that differ in exactly one bit. Every fingerprint looks up those with one more bit set."""
    fp = F.col("fp")
    more = [F.when(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)) == 0, fp.bitwiseOR(F.lit(_signed(1 << b)))) for b in range(BITS)]
    flipped = vertices.select(fp.alias("a"), F.explode(F.array_compact(F.array(*more))).alias("b"))
    return flipped.join(vertices.select(fp.alias("b")), ["b"]).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, tau: int = 4) -> DataFrame:
    """One row for each row of df: doc_id, fp (long), component_id.

    component_id is the smallest doc_id that is reached over links (equal fingerprints, or at most tau differing bits), the
    row's own included; rows without a doc_id count as vertices but never give their name, so a component of such rows has
    a null one. Null and wordless texts have fingerprint 0 and link like any other. Repeated rows each get a row.
    """
    docs = checkpointed(fingerprints(df, id_col, text_col, shingle_words))
    vertices = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    grouped = label_components(close_links(vertices).unionByName(head_links(vertices, tau))).toDF("fp", "label")
    groups = checkpointed(vertices.join(grouped, ["fp"], "left").select("fp", "first_id", "rows", F.coalesce("label", "fp").alias("grp")))
    links = near_links(groups, tau).join(groups.select(F.col("fp").alias("src"), F.col("grp").alias("a")), ["src"]).join(groups.select(F.col("fp").alias("dst"), F.col("grp").alias("b")), ["dst"])
    merged = label_components(links.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()).toDF("grp", "label")
    labelled = groups.join(merged, ["grp"], "left").withColumn("label", F.coalesce("label", "grp"))
    names = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    # Vertices that stand alone keep their own first_id: only those in groups of several need the second table.
    # A group of many vertices is dealt over SALTS tasks.
    salted = names.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = labelled.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    linked = dealt.join(salted, ["label", "salt"]).select("fp", F.struct("component_id").alias("named"))
    named = vertices.join(linked, ["fp"], "left").select("fp", "rows", F.when(F.col("named").isNull(), F.col("first_id")).otherwise(F.col("named.component_id")).alias("component_id"))
    # A fingerprint with a large share of all rows is joined by broadcast: there are at most HOT_SHARE such, whatever the input.
    most = max(1, docs.count() // HOT_SHARE)
    hot = checkpointed(named.where(F.col("rows") > most).drop("rows"))
    often = docs.join(F.broadcast(hot), ["fp"]).select("doc_id", "fp", "component_id")
    others = docs.join(F.broadcast(hot.select("fp")), ["fp"], "left_anti").join(named.drop("rows"), ["fp"]).select("doc_id", "fp", "component_id")
    return others.unionByName(often)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, tau: int = 4) -> DataFrame:
    """The rows of df, all columns, that give their component its name; rows without an id stay. Of repeated rows with that id one stays."""
    found = checkpointed(near_duplicates(df, id_col, text_col, shingle_words, tau))
    kept = df.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), [id_col], "left_anti")
    again = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col))
    if again.isEmpty():
        return kept.select(df.columns)
    single, repeated = kept.join(again, [id_col], "left_anti"), kept.join(again, [id_col], "left_semi").dropDuplicates([id_col])
    return single.unionByName(repeated).select(df.columns)


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

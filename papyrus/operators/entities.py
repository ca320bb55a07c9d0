"""Names in texts by a gazetteer automaton.

The names are compiled to an Aho-Corasick automaton once per worker, and a text is read once, however many names there are. A match
stands between characters that are neither letters nor digits; of matches that overlap, the leftmost counts, and of those
with one start the longest. The automaton is sent to the tasks, so a gazetteer is cut into parts of at most ``MOST_NAMES`` names; each part
reads the texts on its own, and what the parts have found is put together within each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of one automaton: some tens of bytes for each of their characters.
MOST_NAMES = 100_000
FOUND = "doc_id long, kind string, name string, start long, end long"


def _lowered(text: str) -> str:
    """Lower case, by characters: those whose lower case has another length stay as they are, so places are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Gazetteer:
    """kind and name of each entry, looked up without regard to case; of equal names the least kind counts."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.automaton, self.any = ahocorasick.Automaton(), False
        for kind, name in sorted(entries, reverse=True):  # the last one added under a key stays
            if name:
                self.automaton.add_word(_lowered(name), (kind, name))
                self.any = True
        if self.any:
            self.automaton.make_automaton()

    def all_matches(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, name) of every name that stands alone, in the order of the ends."""
        if not self.any:
            return
        low, n = _lowered(text), len(text)
        for last, (kind, name) in self.automaton.iter(low):
            start, end = last + 1 - len(name), last + 1
            if (start == 0 or not (low[start - 1].isalnum() and low[start].isalnum())) and (end == n or not (low[end].isalnum() and low[last].isalnum())):
                yield start, end, kind, name


def leftmost_longest(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of matches in any order those that do not overlap: the leftmost first, and the longest of a start."""
    out, at = [], 0
    for match in sorted(found, key=lambda m: (m[0], -m[1])):
        if match[0] >= at:
            out.append(match)
            at = match[1]
    return out


def entities(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_names: int = MOST_NAMES) -> DataFrame:
    """FOUND: every name of gazetteer (kind, name) in the whole texts; start and end in characters, end exclusive.

    Null and empty texts and names give nothing, repeated rows each give their matches (a row is told apart by its place in the table).
    """
    entries = gazetteer.select("kind", "name").where("kind IS NOT NULL AND name <> ''").groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("kind", "name")).alias("e")).select("e.kind", "e.name")
    parts = max(1, -(-entries.count() // most_names))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64(F.lower("name")), F.lit(parts)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def one(names: list[tuple[str, str]], whole: bool) -> DataFrame:
        """Matches of one part of the gazetteer; with whole it is the only one, so that overlaps are settled at once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Gazetteer(names)
            for batch in batches:
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got = list(known.all_matches(text))
                    rows += [(doc, m[2], m[3], m[0], m[1]) for m in (leftmost_longest(got) if whole else sorted(got))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "kind", "name", "start", "end"])

        return texts.mapInArrow(run, FOUND)

    # A part has at most about most_names names, so what reaches the driver and the tasks is bounded, whatever the gazetteer.
    lists = [[(r["kind"], r["name"]) for r in dealt.where(F.col("part") == k).select("kind", "name").toLocalIterator()] for k in range(parts)]
    if parts == 1:
        return one(lists[0], True)
    found = one(lists[0], False)
    for names in lists[1:]:
        found = found.unionByName(one(names, False))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        best = leftmost_longest(list(zip(rows["start"], rows["end"], rows["kind"], rows["name"], strict=True)))
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "kind": [m[2] for m in best], "name": [m[3] for m in best], "start": [m[0] for m in best], "end": [m[1] for m in best]})

    return found.distinct().groupBy("doc_id").applyInPandas(settle, FOUND)


def entity_counts(found: DataFrame, k: int = 10) -> DataFrame:
    """(kind, rank, name, n, kind_total, kinds, total): the k most frequent names of each kind (ties by name), with the kind's and all kinds' matches."""
    n = found.groupBy("kind", "name").agg(F.count("*").alias("n"))
    totals = n.groupBy("kind").agg(F.sum("n").alias("kind_total"))
    every = totals.agg(F.count("*").alias("kinds"), F.sum("kind_total").alias("total"))  # one row
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "name"))).where(F.col("rank") <= k)
    return ranked.join(totals, ["kind"]).join(F.broadcast(every)).select("kind", "rank", "name", "n", "kind_total", "kinds", "total")

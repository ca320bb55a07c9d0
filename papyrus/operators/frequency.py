"""Term, bigram and co-occurrence frequencies. Counts are summed on the map side; only distinct terms are shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.functions import text as T
from papyrus.functions.stats import top_k, top_k_by


def _counts(df: DataFrame, words: Column, *groups: str) -> DataFrame:
    return df.select(*groups, F.explode(words).alias("term")).groupBy(*groups, "term").agg(F.count("*").alias("n"))


def top_terms(papers: DataFrame, k: int = 15, least: int = 3, stops: list[str] = T.ABSTRACT_STOPS, col: str = "abstract") -> DataFrame:
    return top_k(_counts(papers, T.letter_words(F.col(col), least)).where(~F.col("term").isin(stops)), "n", k, "term")


def title_terms(papers: DataFrame, k: int = 12) -> DataFrame:
    return top_terms(papers, k, 3, T.TITLE_STOPS, "title")


def top_bigrams(papers: DataFrame, k: int = 10) -> DataFrame:
    """Bigrams of words of four or more letters within each abstract."""
    tokens = papers.select(T.letter_words(F.col("abstract"), 4).alias("tokens"))
    pairs = tokens.select(F.explode(T.bigrams(F.col("tokens"), T.BIGRAM_STOPS)).alias("term"))
    return top_k(pairs.groupBy("term").agg(F.count("*").alias("n")), "n", k, "term")


def query_term_frequency(papers: DataFrame, query: str) -> DataFrame:
    """For each word of the query of more than two letters: abstracts that hold it anywhere, and their percentage."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    low = F.lower(F.coalesce("abstract", F.lit("")))
    one = papers.agg(F.count("*").alias("total"), *[F.count_if(F.contains(low, F.lit(w))).alias(w) for w in words])
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(w).alias("n_docs")) for w in words]))
    return one.select(rows.alias("r"), "total").select("r.term", "r.n_docs", F.round(F.try_divide(F.col("r.n_docs") * 100.0, "total"), 4).alias("percent"))


def cooccurrence(papers: DataFrame, k: int = 8) -> DataFrame:
    """(a, b, n): documents that hold both of two of the k most frequent terms; a comes before b in rank."""
    words = T.letter_words(F.col("abstract"), 4)
    best = top_k(_counts(papers, words).where(~F.col("term").isin(T.COOCCURRENCE_STOPS)), "n", k, "term")
    # k terms in one row: the pairs of a document are made inside its row.
    ordered = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x["term"]).alias("best"))
    sets = papers.select(F.array_distinct(words).alias("words")).join(F.broadcast(ordered))
    own = sets.select(F.filter("best", lambda t: F.array_contains("words", t)).alias("own"))
    pairs = F.flatten(F.transform("own", lambda a, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.where(F.size("own") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def top_terms_by_journal(papers: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent terms of each journal, with the journal's papers and mean abstract length."""
    words = T.letter_words(F.col("abstract"))
    terms = _counts(papers, words, "journal").where(~F.col("term").isin(T.ABSTRACT_STOPS))
    best = top_k_by(terms, ["journal"], "n", k, "term")
    journals = papers.groupBy("journal").agg(F.count("*").alias("papers"), F.round(F.avg(F.length("abstract")), 4).alias("mean_length"))
    return best.join(journals, ["journal"]).select("journal", "rank", "term", "n", "papers", "mean_length")


def cloud_weights(papers: DataFrame, k: int = 30) -> DataFrame:
    """Terms of four or more letters with a weight from 0 to 100 relative to the most frequent."""
    best = top_terms(papers, k, 4, T.CLOUD_STOPS)
    top = best.agg(F.max("n").alias("most"))
    return best.join(F.broadcast(top)).select("term", "n", F.floor(F.col("n") * 100 / F.col("most")).alias("weight"))


def tfidf(papers: DataFrame, features: int = 1000, min_df: int = 2, max_df: float = 0.8, k: int = 5) -> DataFrame:
    """The k terms of highest tf-idf of each paper, over the ``features`` terms of highest total count within the document frequency limits.

    Terms are words and pairs of neighbouring words, stop words taken out first. idf is ln((1 + n) / (1 + df)) + 1; a paper's weights have length one.
    doc_id is unique: a paper's terms are counted in its row, and only a task's distinct terms are shuffled.
    """
    own = papers.select("doc_id", F.filter(T.letter_words(F.col("abstract"), 2), lambda t: ~t.isin(T.ABSTRACT_STOPS)).alias("own"))
    counted = _counted(own.select("doc_id", F.concat("own", T.bigrams(F.col("own"), [])).alias("terms")), papers.schema["doc_id"].dataType.simpleString())
    total = papers.agg(F.count("*").alias("docs"))
    terms = counted.select(F.explode("counts").alias("c")).groupBy("c.term").agg(F.count("*").alias("df"), F.sum("c.tf").alias("total")).join(F.broadcast(total))
    kept = top_k(terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs"))), "total", features, "term")
    idf = {r["term"]: r["idf"] for r in kept.select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")).collect()}  # at most ``features`` rows
    weighted = _counted(own.select("doc_id", F.concat("own", T.bigrams(F.col("own"), [])).alias("terms")), papers.schema["doc_id"].dataType.simpleString(), idf)
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, c: s + c["tf"] * c["tf"]))
    ordered = F.array_sort(F.transform("counts", lambda c: F.struct((-F.round(c["tf"] / F.col("norm"), 6)).alias("less"), c["term"].alias("term"))))
    best = weighted.where(F.size("counts") > 0).withColumn("norm", norm).select("doc_id", F.posexplode(F.slice(ordered, 1, k)).alias("pos", "c"))
    return best.select("doc_id", "c.term", (-F.col("c.less")).alias("weight"), (F.col("pos") + 1).alias("rank"))


def _counted(papers: DataFrame, kind: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, counts: term, tf) of papers (doc_id, terms), row by row; with ``weights`` tf times the weight, of the terms that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = []
                for terms in part.column(1).to_pylist():
                    tf = Counter(terms if weights is None else (t for t in terms if t in weights))
                    found.append([{"term": t, "tf": float(n if weights is None else n * weights[t])} for t, n in tf.items()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.float64())])))], ["doc_id", "counts"])

    return papers.mapInArrow(run, f"doc_id {kind}, counts array<struct<term: string, tf: double>>")

"""Search, batching, coverage and text statistics of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T
from papyrus.functions.stats import histogram, ranked


def search(papers: DataFrame, term: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the papers whose abstract holds the term, by pmid number."""
    return papers.where(F.contains(F.lower("abstract"), F.lit(term.lower()))).orderBy("doc_id").offset(offset).limit(limit).select("doc_id", "pmid", T.shortened(F.col("title"), 50).alias("title"))


def search_dates(papers: DataFrame, col: str, term: str, start: str, end: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the dated papers whose column holds the term, published from start to end (yyyy/MM/dd, both included), by pmid."""
    within = F.col("pub_date").between(F.to_date(F.lit(start), "yyyy/MM/dd"), F.to_date(F.lit(end), "yyyy/MM/dd"))
    return papers.where(F.contains(F.lower(col), F.lit(term.lower())) & within).orderBy("pmid").offset(offset).limit(limit).select("pmid", "pub_date", col)


def batch_size(n: int, with_key: bool) -> int:
    """How many ids a request takes: a fifth of them (50 to 200) with an access key, a tenth (20 to 100) without."""
    return min(200, max(50, n // 5)) if with_key else min(100, max(20, n // 10))


def conversion_batch(n: int, with_key: bool) -> int:
    """How many ids a conversion request takes: all up to 200, at least 100, with an access key; up to 100, at least 50, without."""
    return min(200, max(100, n)) if with_key else min(100, max(50, n))


def numbered_within(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """rows with their place (1, 2, ...) by id within a group of bounded size."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(id_col)))


def batches(papers: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """(batch, n, first_id, last_id) of consecutive batches by id."""
    numbered = ranked(papers.select(id_col), id_col)
    return numbered.groupBy(F.floor((F.col("row_no") - 1) / size).alias("batch")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def coverage(papers: DataFrame) -> DataFrame:
    """One row: total, with_abstract, without_abstract, percent (0 if there are no papers), mean_length of non-empty abstracts."""
    has = T.filled(F.col("abstract"))
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(has).alias("with_abstract"),
        F.count_if(~has).alias("without_abstract"),
        F.round(F.coalesce(F.try_divide(F.count_if(has) * 100.0, F.count("*")), F.lit(0.0)), 4).alias("percent"),
        F.round(F.coalesce(F.avg(F.when(F.length("abstract") > 0, F.length("abstract"))), F.lit(0.0)), 4).alias("mean_length"),
    )


def coverage_suggestions(stats: DataFrame, least_percent: float = 98.0) -> DataFrame:
    """One row for each rule that a coverage row (with errors, if there is such a column) fires: missing abstracts, errors, low coverage. A corpus without papers fires none."""
    stats = stats if "errors" in stats.columns else stats.withColumn("errors", F.lit(0))
    rules = F.array(
        F.when(F.col("without_abstract") > 0, F.concat(F.lit("recover "), F.col("without_abstract").cast("string"), F.lit(" abstracts"))),
        F.when(F.col("errors") > 0, F.concat(F.lit("retry "), F.col("errors").cast("string"), F.lit(" failed requests"))),
        F.when((F.col("total") > 0) & (F.col("percent") < least_percent), F.lit("ask for missing abstracts one by one")),
    )
    return stats.select(F.explode(F.array_compact(rules)).alias("suggestion"))


def word_count_histogram(papers: DataFrame, bins: int = 15) -> DataFrame:
    return histogram(papers.select(T.word_count(F.col("abstract")).alias("n_words")), "n_words", bins, up_to_distinct=True)


def sentence_length_counts(papers: DataFrame) -> DataFrame:
    """(words, n) over all sentences of more than three words."""
    return papers.select(F.explode(T.sentence_lengths(F.col("abstract"))).alias("words")).groupBy("words").agg(F.count("*").alias("n"))


def text_summary(papers: DataFrame) -> DataFrame:
    """One row: papers, with_abstracts, total and mean words, distinct terms, mean readability."""
    has = T.filled(F.col("abstract"))
    n = T.word_count(F.col("abstract"))
    one = papers.agg(
        F.count("*").alias("papers"), F.count_if(has).alias("with_abstracts"), F.sum(n).alias("total_words"),
        F.round(F.avg(F.when(has, n)), 4).alias("mean_words"), F.round(F.avg(F.when(has, T.readability(F.col("abstract")))), 4).alias("mean_readability"),
    )
    terms = papers.select(F.explode(T.letter_words(F.col("abstract"))).alias("w")).agg(F.count_distinct("w").alias("distinct_terms"))
    return one.join(F.broadcast(terms))  # one row each


def readability_table(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", F.round(T.readability(F.col("abstract")), 6).alias("readability"), T.word_count(F.col("abstract")).alias("n_words"))


def flesch_by_journal(papers: DataFrame) -> DataFrame:
    return papers.groupBy("journal").agg(F.count("*").alias("n"), F.round(F.avg(T.flesch(F.col("abstract"))), 4).alias("flesch_syllabic"))


def normalized_table(papers: DataFrame) -> DataFrame:
    t = T.normalized(F.col("abstract"))
    return papers.select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("md5"), T.shortened(F.col("title"), 30).alias("label"), T.clean_pmid(F.col("pmid")).alias("clean_pmid"))


def overview(papers: DataFrame) -> DataFrame:
    """(measure, value): papers, those with an abstract and with 100 characters or more, journals, languages, texts with a full stop."""
    t = F.coalesce("abstract", F.lit(""))
    one = papers.agg(F.count("*").alias("papers"), F.count_if(T.filled(F.col("abstract"))).alias("with_abstract"), F.count_if(F.length(t) >= 100).alias("long"), F.count_distinct("journal").alias("journals"), F.count_distinct("keyword").alias("languages"), F.count_if(F.contains(t, F.lit("."))).alias("with_sentences"))
    return one.unpivot([], one.columns, "measure", "value")

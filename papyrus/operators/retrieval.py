"""Questions, chunks, ranking, extractive answers and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T

# A question's type is the first whose word it holds; where its contexts are searched.
QUESTION_TYPES = [
    ("methodological", ["method", "approach", "technique", "how"]),
    ("findings", ["finding", "result", "discover", "show"]),
    ("temporal", ["trend", "evolution", "change", "over time"]),
    ("limitations", ["limitation", "challenge", "problem", "gap"]),
    ("future_work", ["future", "next", "recommend", "suggest"]),
]
TARGETS = {"methodological": ["section", "fulltext", "abstract"], "findings": ["abstract", "section", "fulltext"], "thematic": ["abstract", "fulltext"]}
DEFAULT_TARGETS = ["abstract", "fulltext", "section"]


def question_type(question: Column) -> Column:
    low, found = F.lower(F.coalesce(question, F.lit(""))), None
    for name, words in QUESTION_TYPES:
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit |= F.contains(low, F.lit(w))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("general")


def search_targets(kind: Column) -> Column:
    found = None
    for name, targets in TARGETS.items():
        value = F.array(*map(F.lit, targets))
        found = F.when(kind == name, value) if found is None else found.when(kind == name, value)
    return found.otherwise(F.array(*map(F.lit, DEFAULT_TARGETS)))


def classify(questions: DataFrame, limit: int = 5) -> DataFrame:
    """questions (question_id, question) with type, targets and the limit that each target gets of ``limit``."""
    typed = questions.withColumn("type", question_type(F.col("question")))
    out = typed.withColumn("targets", search_targets(F.col("type")))
    return out.withColumn("limit_each", F.floor(F.lit(limit) / F.size("targets")).cast("int"))


def chunk_bounds(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """(start, end) of a text's chunks: ``size`` characters, cut back to after the last .!? in the second half, ``overlap`` shared with the next. Only a chunk's second half is looked at again."""
    start, n = 0, len(text)
    while n:
        end, middle = min(start + size, n), start + size // 2
        if end < n:
            back = max(text.rfind(c, middle, end + 1) for c in ".!?") + 1
            end = back or end
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


def chunks(papers: DataFrame, size: int = 500, overlap: int = 50, longer_than: int = 50) -> DataFrame:
    """(doc_id, chunk_id, start, text) of the chunks with more than ``longer_than`` characters without their outer white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, k, s, t[s:e]) for doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (s, e) in enumerate(chunk_bounds(t, size, overlap))]
            for lo in range(0, max(1, len(rows)), 10_000):
                columns = list(zip(*rows[lo : lo + 10_000], strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "chunk_id", "start", "text"])

    own = papers.select(F.col("doc_id").cast("long"), F.coalesce("abstract", F.lit("")).alias("t"))
    cut = own.mapInArrow(run, "doc_id long, chunk_id int, start int, text string")
    return cut.where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > longer_than)


def eligible_counts(papers: DataFrame) -> DataFrame:
    """(kind, n): papers whose abstract has over 50 characters, whose whole text over 100, and sections (lines of the text) of over 100."""
    n = F.length(F.trim(F.coalesce("abstract", F.lit(""))))
    sections = F.size(F.filter(F.split(F.coalesce("abstract", F.lit("")), "\n"), lambda s: F.length(F.trim(s)) > 100))
    one = papers.agg(F.count_if(n > 50).alias("abstract"), F.count_if(n > 100).alias("fulltext"), F.coalesce(F.sum(sections), F.lit(0)).cast("long").alias("section"))
    return one.unpivot([], ["abstract", "fulltext", "section"], "kind", "n")


def dedupe_contexts(found: DataFrame, limit: int = 5) -> DataFrame:
    """found: query_id, paper_id, target_rank, rank, score -> of each paper the first in target order, then by score, at most ``limit``."""
    first = Window.partitionBy("query_id", "paper_id").orderBy("target_rank", "rank")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "paper_id")
    one = found.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return one.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("query_id", "place", "paper_id", "score")


def confidence(contexts: DataFrame) -> DataFrame:
    """(query_id, confidence, sources): the mean score, 0.95 at most."""
    return contexts.groupBy("query_id").agg(F.round(F.least(F.avg("score"), F.lit(0.95)), 6).alias("confidence"), F.count_distinct("paper_id").alias("sources"))


def extractive_answers(pairs: DataFrame, most: int = 3) -> DataFrame:
    """pairs: id, question, context -> the sentences (over 20 characters) that share most words with the question, joined; else the first 200 characters."""
    asked = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("question"), r"\s+", " ")), " "))
    sentences = pairs.select("id", "context", asked.alias("asked"), F.posexplode(F.split("context", r"\.")).alias("pos", "s"))
    trimmed = sentences.withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " "))).where(F.length("s") > 20)
    scored = trimmed.withColumn("overlap", F.size(F.array_intersect("asked", F.array_distinct(F.split(F.lower("s"), " "))))).where("overlap > 0")
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("overlap").desc(), "pos"))).where(F.col("rn") <= most)
    joined = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), ". ").alias("answer"), F.sum("overlap").alias("overlap"))
    return pairs.join(joined, ["id"], "left").select("id", F.coalesce("answer", F.substring("context", 1, 200)).alias("answer"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def analysis_prompts(papers: DataFrame, most: int = 3000) -> DataFrame:
    """(doc_id, n_chars, truncated, md5) of the prompt text: the text if it has 100 characters, cut at ``most``."""
    t = F.coalesce("abstract", F.lit(""))
    used = F.when(F.length(F.trim(t)) >= 100, t).otherwise(F.coalesce("title", F.lit("")))
    cut = F.when(F.length(used) > most, F.concat(F.substring(used, 1, most), F.lit("... [truncated]"))).otherwise(used)
    prompt = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nText: "), cut)
    return papers.select("doc_id", F.length(prompt).alias("n_chars"), (F.length(used) > most).alias("truncated"), F.md5(prompt).alias("md5"))


#: Questions that are always asked, in own wording.
FIXED_QUESTIONS = [
    "What are the main research methodologies used in these papers?",
    "What are the key findings and results reported?",
    "What are the current limitations and challenges in this field?",
    "What future research directions are suggested?",
    "How has the research evolved over time?",
]


def generated_questions(papers: DataFrame, years: DataFrame) -> DataFrame:
    """(question_id, question): the fixed ones, one on the three most frequent keywords, one on the years if there are several."""
    spark = papers.sparkSession
    fixed = spark.createDataFrame(list(enumerate(FIXED_QUESTIONS)), "question_id int, question string")
    best = papers.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(3)
    listed = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "keyword"))), lambda x: x["keyword"]), ", ").alias("k")).where("k <> ''")
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo < hi")
    more = listed.select(F.lit(5).alias("question_id"), F.concat(F.lit("How do these papers treat "), "k", F.lit("?")).alias("question"))
    time = span.select(F.lit(6).alias("question_id"), F.concat(F.lit("What changed between "), F.col("lo").cast("string"), F.lit(" and "), F.col("hi").cast("string"), F.lit("?")).alias("question"))
    return fixed.unionByName(more).unionByName(time)


def corpus_context(papers: DataFrame, k: int = 20, most: int = 200) -> DataFrame:
    """One row: the first k papers' titles and abstracts (cut at ``most``) as one text, with a note on the rest."""
    first = papers.orderBy("doc_id").limit(k).select("doc_id", F.concat(T.shortened(F.coalesce("title", F.lit("")), 50), F.lit(": "), T.shortened(F.coalesce("abstract", F.lit("")), most)).alias("line"))
    text = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n").alias("context"))
    rest = papers.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("rest"))
    return text.join(F.broadcast(rest)).select(F.length("context").alias("n_chars"), F.md5("context").alias("md5"), "rest")

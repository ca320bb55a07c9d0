"""Prompts and model settings as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T

#: Own wording, by question type; other types take the general one.
TEMPLATES = {
    "general": "Answer the question from the papers below, with details and citations.\nQuestion: {question}\n\n{context}",
    "methodological": "Answer the question from the methods that the papers below use: design, data, analysis.\nQuestion: {question}\n\n{context}",
    "findings": "Answer the question from the results that the papers below report.\nQuestion: {question}\n\n{context}",
    "analytical": "Answer the question by what the papers below have in common: patterns, trends, insights.\nQuestion: {question}\n\n{context}",
}
COMPARISONS = {
    "methodology_comparison": "Compare the methods of {n} papers.\n{papers}\nName common and new approaches, strengths and weaknesses.",
    "findings_synthesis": "Put together the findings of {n} papers.\n{papers}\nName agreement, contradiction and gaps.",
    "quality_ranking": "Rank {n} papers by scientific quality.\n{papers}\nGive a reason for each place.",
}
#: Category -> own wording of the question.
INSIGHTS = {
    "methodology_trends": "Which methods prevail in these papers, and how do they change?",
    "key_findings": "Which findings of these papers matter most?",
    "research_gaps": "Which gaps and limits do these papers name?",
    "future_directions": "Which further research do these papers propose?",
    "technology_evolution": "How did the tools and technologies of this field develop?",
    "collaboration_patterns": "Who works together in these papers?",
}
# Type and context limit of the insight questions.
INSIGHT_TYPE, INSIGHT_LIMIT = "analytical", 10


def rag_prompt(kind: Column, question: Column, context: Column) -> Column:
    """The template of the type (general for others) with question and context filled in."""
    template = F.coalesce(F.element_at(F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(TEMPLATES["general"]))
    parts = F.split(template, r"\{question\}|\{context\}")
    return F.concat(F.get(parts, 0), F.coalesce(question, F.lit("")), F.get(parts, 1), F.coalesce(context, F.lit("")), F.get(parts, 2))


def comparative_prompts(papers: DataFrame, k: int = 10, most: int = 300) -> DataFrame:
    """(aspect, prompt) over the first k papers (by doc_id), abstracts cut at ``most``, and the number of all."""
    first = papers.orderBy("doc_id").limit(k)
    line = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), T.shortened(F.coalesce("abstract", F.lit("none")), most))
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x, i: F.concat(F.lit("Paper "), (i + 1).cast("string"), F.lit("\n"), x["line"])).alias("lines"))
    one = listed.join(F.broadcast(papers.agg(F.count("*").alias("n"))))  # one row each
    filled = [F.struct(F.lit(a).alias("aspect"), F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("n").cast("string")), F.lit("{papers}"), F.array_join("lines", "\n")).alias("prompt")) for a, t in COMPARISONS.items()]
    return one.select(F.explode(F.array(*filled)).alias("p")).select("p.*")


def model_settings(kind: Column, large: str = "large", small: str = "small") -> tuple[Column, Column]:
    """(model, token limit) by analysis type: comparisons and insights take the large model, comparisons the longer answer."""
    comparing = F.contains(kind, F.lit("comparative"))
    return F.when(comparing | F.contains(kind, F.lit("insight")), large).otherwise(small), F.when(comparing, 800).otherwise(500)


def quality_bucket(score: Column) -> Column:
    """Of a score from 0 to 100."""
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def insight_questions(spark: SparkSession) -> DataFrame:
    """(category, question, type, context_limit)."""
    rows = [(c, q, INSIGHT_TYPE, INSIGHT_LIMIT) for c, q in INSIGHTS.items()]
    return spark.createDataFrame(rows, "category string, question string, type string, context_limit int")


def question_contexts(questions: DataFrame, papers: DataFrame, most: int = INSIGHT_LIMIT) -> DataFrame:
    """questions (category, question, type, context_limit; few rows) with the papers, context_limit and ``most`` at most, that hold most of their words of more than two letters anywhere."""
    listed = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2))
    asked = questions.select("category", "type", "context_limit", listed.alias("words")).agg(F.collect_list(F.struct("category", "type", "context_limit", "words")).alias("asked"))
    low = F.lower(F.coalesce("abstract", F.lit("")))
    counted = F.transform("asked", lambda q: F.struct(q["category"].alias("category"), q["type"].alias("type"), q["context_limit"].alias("most"), F.size(F.filter(q["words"], lambda w: F.contains(low, w))).alias("shared")))
    rows = papers.join(F.broadcast(asked)).select("doc_id", F.explode(counted).alias("q")).select("doc_id", "q.*").where("shared > 0")  # the questions are one row
    w = Window.partitionBy("category").orderBy(F.col("shared").desc(), "doc_id")
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & (F.col("place") <= F.col("most"))).withColumn("shared", F.col("shared").cast("long"))


def chunk_metadata(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_id, ...) with their paper's pmid, title and journal, joined by id."""
    return chunks.join(papers.select("doc_id", "pmid", "title", "journal"), ["doc_id"])

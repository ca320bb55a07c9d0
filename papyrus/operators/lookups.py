"""Answers of lookup services as JSON columns, cascades over sources, output names, request pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T


def cross_search_id(json: Column) -> Column:
    """The first id of a search answer, with the PMC prefix; null without any."""
    return F.concat(F.lit("PMC"), F.get_json_object(json, "$.esearchresult.idlist[0]"))


def open_access_link(paper: Column, location: Column) -> Column:
    """The link of a paper answer, else, if it is open, that of the best location of a location answer; null without either."""
    own = F.nullif(F.get_json_object(paper, "$.openAccessPdf.url"), F.lit(""))
    is_open = F.get_json_object(location, "$.is_oa") == "true"
    return F.coalesce(own, F.when(is_open, F.nullif(F.get_json_object(location, "$.best_oa_location.url_for_pdf"), F.lit(""))))


def first_answer(answers: DataFrame, key: str, priority: Column, usable: Column) -> DataFrame:
    """Of each key's answers the usable one of best priority: every source is asked only for what those before it did not give."""
    best = F.min_by(F.struct(*[F.col(c) for c in answers.columns if c != key]), priority)
    return answers.where(usable).groupBy(key).agg(best.alias("a")).select(key, "a.*")


def first_yielding_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows: batch, pmid, source, abstract -> the abstracts that a batch gets from the first source, in the given order, that yields any."""
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    found = rows.where(T.filled(F.col("abstract"))).withColumn("order", order)
    first = found.groupBy("batch").agg(F.min("order").alias("order"))
    return found.join(first, ["batch", "order"], "left_semi").select("batch", "pmid", "source", "abstract")


def output_names(papers: DataFrame) -> DataFrame:
    """papers (pmid, pmcid, title) with paper_id, map_key and file: named by the clean pmcid, else by the clean pmid, else by a hash of the title."""
    pmc, pm = F.regexp_replace("pmcid", "(?i)^PMC", ""), T.clean_pmid(F.col("pmid"))
    unknown = F.concat(F.lit("unknown_"), F.md5(F.coalesce("title", F.lit(""))))
    key = F.coalesce("pmcid", "pmid", unknown)
    name = F.coalesce(F.concat(F.lit("PMC"), pmc), F.concat(F.lit("pmid_"), pm), unknown)
    return papers.withColumn("paper_id", F.coalesce("pmid", unknown)).withColumn("map_key", key).withColumn("file", F.concat(name, F.lit(".md")))


def with_files(papers: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """papers with has_file: whether their path is set and in the listing (path)."""
    there = listing.select(F.col("path").alias(path)).distinct().withColumn("there", F.lit(True))
    return papers.join(there, [path], "left").withColumn("has_file", F.col(path).isNotNull() & F.coalesce("there", F.lit(False))).drop("there")


def pdf_listing(files: DataFrame) -> DataFrame:
    """Of a listing (path, is_folder) the files that end in .pdf, in any case; empty files are files."""
    return files.where(F.lower("path").endswith(".pdf") & ~F.col("is_folder"))


def backoff(requests: DataFrame, delay: float = 1.0, decay: float = 0.9, floor: float = 0.2) -> DataFrame:
    """requests: client, request, try (from 0), status, ts, event_id -> with action and wait, in seconds, of each.

    Status 429 waits delay * 2^try, times up to 5 as refusals outnumber successes, three times at most; 502 to 504 wait 2 (try + 1), twice
    at most; anything else from 400 on fails at once. A success lowers the excess of refusals (never under 0) and the
    delay. Such an excess is a running sum less its lowest value so far, so the fold needs no state of its own.
    """
    order = Window.partitionBy("client").orderBy("ts", "event_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("status") == 429, 1).when(F.col("status") < 400, -1).otherwise(0)
    run = requests.withColumn("run", F.sum(step).over(upto))
    run = run.withColumn("excess", F.col("run") - F.least(F.lit(0), F.min("run").over(upto)))
    run = run.withColumn("delay", F.greatest(F.lit(floor), delay * F.pow(F.lit(decay), F.coalesce(F.count_if(F.col("status") < 400).over(before), F.lit(0)))))
    busy, down = F.col("status") == 429, F.col("status").isin(502, 503, 504)
    again = (busy & (F.col("try") < 3)) | (down & (F.col("try") < 2))
    wait = F.when(busy, F.col("delay") * F.pow(F.lit(2.0), "try") * F.least(F.lit(5.0), 1 + 0.5 * F.col("excess"))).otherwise(2.0 * (F.col("try") + 1))
    action = F.when(again, "retry").when(F.col("status") >= 400, "fail").otherwise("done")
    return run.select("client", "request", "event_id", action.alias("action"), F.round(F.when(again, wait).otherwise(0.0), 6).alias("wait"))

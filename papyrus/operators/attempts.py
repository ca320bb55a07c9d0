"""Fetch attempts: routing, first success, statistics, retries, breaker and rate limits as folds over ordered attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Strategies with priority, in stable order, and what each needs.
STRATEGIES = [
    ("EuropePMC", 0, "pmcid"), ("PMC OA", 1, "pmcid"), ("Direct PMC", 2, "pmcid"), ("Enhanced DOI", 3, "doi"), ("DOI", 3, "doi"), ("arXiv", 4, "arxiv"),
    ("arXiv API", 5, "arxiv"), ("PyPaperBot", 7, "title or doi"), ("Semantic Scholar", 8, "any"), ("Unpaywall", 10, "doi"),
]


def strategies(spark: SparkSession) -> DataFrame:
    rows = [(n, p, k, need) for k, (n, p, need) in enumerate(STRATEGIES)]
    return spark.createDataFrame(rows, "strategy string, priority int, position int, needs string")


def applicable(needs: Column) -> Column:
    """Whether a paper (pmcid, doi, title) has what a strategy needs."""
    arxiv = F.coalesce(F.contains(F.lower("doi"), F.lit("arxiv")), F.lit(False)) | F.coalesce(F.contains(F.lower("title"), F.lit("arxiv")), F.lit(False))
    has = {c: F.col(c).isNotNull() for c in ("pmcid", "doi", "title")}
    return F.when(needs == "pmcid", has["pmcid"]).when(needs == "doi", has["doi"]).when(needs == "arxiv", arxiv).when(needs == "title or doi", has["title"] | has["doi"]).otherwise(has["pmcid"] | has["doi"] | has["title"])


def routes(papers: DataFrame) -> DataFrame:
    """papers (paper, pmcid, doi, title; pmid if there is one) x the ten strategies that apply, in the order in which they are tried."""
    s = strategies(papers.sparkSession)
    papers = papers if "pmid" in papers.columns else papers.withColumn("pmid", F.lit(None).cast("string"))
    w = Window.partitionBy("paper").orderBy("priority", "position")
    return papers.join(F.broadcast(s)).where(applicable(F.col("needs"))).withColumn("place", F.row_number().over(w)).select("paper", "place", "strategy", candidate_url(F.col("strategy")).alias("candidate"))


def candidate_url(strategy: Column) -> Column:
    """What a strategy would ask for, as an address (host names are made up) or, where a service answers first, as service:query. Of a paper's pmcid, doi, title and, if there is one, pmid; null where the strategy has no form for it.

    arXiv takes what follows the DOI's last slash; its API what stands between the last "arxiv." and the next slash, and searches by title
    without such a DOI.
    """
    number, doi, low = F.replace("pmcid", F.lit("PMC"), F.lit("")), F.col("doi"), F.lower("doi")
    last, named = F.element_at(F.split(doi, "/"), -1), F.element_at(F.split(F.element_at(F.split(doi, r"arxiv\."), -1), "/"), 1)
    on_arxiv = F.coalesce(F.contains(low, F.lit("arxiv")), F.lit(False))
    direct = F.concat(F.lit("https://doi.example/"), doi)
    publisher = F.when(F.contains(low, F.lit("plos")), F.concat(F.lit("https://plos.example/article/file?id="), doi, F.lit("&type=printable"))).when(F.contains(low, F.lit("nature")), F.concat(F.lit("https://nature.example/articles/"), last, F.lit(".pdf"))).otherwise(direct)
    forms = {
        "EuropePMC": F.concat(F.lit("https://europepmc.example/articles/PMC"), number, F.lit("?pdf=render")),
        "PMC OA": F.concat(F.lit("pmc-oa:PMC"), number),
        "Direct PMC": F.concat(F.lit("https://pmc.example/articles/PMC"), number, F.lit("/pdf/")),
        "Enhanced DOI": publisher,
        "DOI": direct,
        "arXiv": F.when(on_arxiv, F.concat(F.lit("https://arxiv.example/pdf/"), last, F.lit(".pdf"))),
        "arXiv API": F.when(on_arxiv, F.concat(F.lit("arxiv:"), named)).otherwise(F.concat(F.lit("arxiv-search:"), "title")),
        "PyPaperBot": F.coalesce(F.concat(F.lit("bot-doi:"), doi), F.concat(F.lit("bot-title:"), "title")),
        "Semantic Scholar": F.coalesce(F.concat(F.lit("scholar:DOI:"), doi), F.concat(F.lit("scholar:PMID:"), F.trim(F.replace("pmid", F.lit("PMID:"), F.lit(""))))),
        "Unpaywall": F.concat(F.lit("unpaywall:"), doi),
    }
    found = None
    for name, form in forms.items():
        found = F.when(strategy == name, form) if found is None else found.when(strategy == name, form)
    return found


def first_success(attempts: DataFrame, priority: Column) -> DataFrame:
    """Of each paper the successful attempt with the best priority, then the earliest."""
    w = Window.partitionBy("paper").orderBy(priority, "ts", "event_id")
    return attempts.where("success").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("paper", "strategy", "event_id")


def batch_result(attempts: DataFrame) -> DataFrame:
    """One row: papers, successful and failed ones, rate (0 without papers)."""
    by = attempts.groupBy("paper").agg(F.bool_or("success").alias("ok"))
    return by.agg(F.count("*").alias("papers"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.coalesce(F.try_divide(F.count_if("ok"), F.count("*")), F.lit(0.0)), 6).alias("rate"))


def strategy_statistics(attempts: DataFrame) -> DataFrame:
    """Successes, failures and rate of each strategy and, as ALL, overall: grouping sets."""
    sets = attempts.groupingSets([[F.col("strategy")], []], F.col("strategy")).agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.grouping("strategy").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("strategy")).alias("strategy"), "ok", "failed", "rate")


def _dated(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("day", F.to_date("ts"))


def breaker_runs(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """Per strategy: longest run of consecutive failures, and how many runs reach the threshold, over the whole log.

    Runs are found within a strategy's days first. Those that touch a day's first or last attempt, and days of failures only,
    are then put together over the days, of which only these counts are left.
    """
    w = Window.partitionBy("strategy", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.sum(F.col("success").cast("int")).over(w), F.lit(0))
    inner = _dated(attempts).withColumn("island", island)
    runs = inner.groupBy("strategy", "day", "island").agg(F.count_if(~F.col("success")).alias("n"))
    last = runs.groupBy("strategy", "day").agg(F.max("island").alias("last"))
    cut = runs.join(last, ["strategy", "day"])
    # A day's island 0 goes on with the run before; its last island starts the run that the next day goes on with.
    before = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("strategy", "day", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("offset"))
    whole = cut.join(offsets, ["strategy", "day"]).groupBy("strategy", (F.col("offset") + F.col("island")).alias("run")).agg(F.sum("n").alias("n"))
    return whole.where("n > 0").groupBy("strategy").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= threshold).alias("opened"), F.count("*").alias("runs"))


def _segments(attempts: DataFrame, known: Column, after: bool, **columns: Column) -> DataFrame:
    """attempts with t, ``columns`` and segment, which changes where a fold's state is known whatever came before.

    known: over t, previous (the time of the strategy's attempt before) and failed (of its last failure before), both over the
    whole log: found within days, and from the days before where a day has none yet. after: whether the new segment begins
    after that attempt or with it.
    """
    own = _dated(attempts).select("event_id", "strategy", "day", F.col("ts").cast("double").alias("t"), "success", *[c.alias(n) for n, c in columns.items()])
    order = Window.partitionBy("strategy", "day").orderBy("t", "event_id")
    past, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, -1 if after else 0)
    days = own.groupBy("strategy", "day").agg(F.max("t").alias("t"), F.max(F.when(~F.col("success"), F.col("t"))).alias("f"))
    earlier = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("strategy", "day", F.max("t").over(earlier).alias("t0"), F.max("f").over(earlier).alias("f0"))
    seen = own.withColumn("p", F.max("t").over(past)).withColumn("f", F.max(F.when(~F.col("success"), F.col("t"))).over(past)).join(carried, ["strategy", "day"])
    seen = seen.withColumn("previous", F.coalesce("p", "t0")).withColumn("failed", F.coalesce("f", "f0"))
    mark = F.when(known, F.struct("t", "event_id"))
    marked = seen.withColumn("mark", mark).withColumn("s", F.max("mark").over(upto))
    day_marks = marked.groupBy("strategy", "day").agg(F.max("mark").alias("m"))
    day_carried = day_marks.select("strategy", "day", F.max("m").over(earlier).alias("m0"))
    return marked.join(day_carried, ["strategy", "day"]).select("event_id", "strategy", "t", "success", *columns, F.coalesce("s", "m0").alias("segment"))


def _folded(segments: DataFrame) -> DataFrame:
    """The rows of a strategy's segment together and in order, segments dealt over all tasks."""
    key = F.xxhash64("strategy", "segment")
    return segments.withColumn("key", key).repartition("key").sortWithinPartitions("key", "t", "event_id")


def breaker_states(attempts: DataFrame, threshold: int = 3, timeout_s: float = 300.0) -> DataFrame:
    """Attempts with the breaker's state before each (closed, open, half-open), for each strategy over the whole log.

    It opens after ``threshold`` failures in a row, lets one attempt through after ``timeout_s``, and any success closes it;
    attempts on an open breaker change nothing. The state depends on its own past, so it is a fold. A success at least ``timeout_s``
    after the last failure leaves the breaker closed whatever came before: the log is cut there, and the segments
    are folded apart, sorted within partitions and streamed, so neither a day nor a segment has to fit in memory.
    """
    known = F.col("success") & (F.col("failed").isNull() | (F.col("t") - F.col("failed") >= timeout_s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, failures, opened = None, 0, None
        for batch in batches:
            states = []
            for k, t, ok in zip(batch["key"], batch["t"], batch["success"], strict=True):
                if key != k:
                    key, failures, opened = k, 0, None
                state = "closed" if opened is None else "open" if t - opened < timeout_s else "half-open"
                states.append(state)
                if state == "open":
                    continue
                failures = 0 if ok else failures + 1
                opened = None if ok else t if failures >= threshold else opened
            yield pd.DataFrame({"event_id": batch["event_id"], "strategy": batch["strategy"], "t": batch["t"], "state": states})

    return _folded(_segments(attempts, known, after=True)).mapInPandas(run, "event_id long, strategy string, t double, state string")


def retry_fold(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Attempts of a paper by the same strategy in order: number of tries (``most`` at most), whether one worked, and the waiting between them (1, 2, 4, ... s)."""
    w = Window.partitionBy("paper", "strategy").orderBy("ts", "event_id")
    tried = attempts.withColumn("try", F.row_number().over(w)).where(F.col("try") <= most)
    return tried.groupBy("paper", "strategy").agg(F.max("try").alias("tries"), F.bool_or("success").alias("ok"), F.max_by("event_id", "try").alias("last_event"), F.sum(F.when(F.col("try") > 1, F.pow(F.lit(2.0), F.col("try") - 2)).otherwise(0.0)).alias("waited"))


def running_rate(attempts: DataFrame, least: int = 20, low: float = 0.5) -> DataFrame:
    """Per strategy: attempts after which the running success rate (over ``least`` or more) was below ``low``, the last rate, and all attempts.

    Running counts within a day start from the sums of the days before.
    """
    w = Window.partitionBy("strategy", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("success").cast("long")
    own = _dated(attempts).select("strategy", "day", F.sum(ok).over(w).alias("ok"), F.count("*").over(w).alias("n"))
    days = _dated(attempts).groupBy("strategy", "day").agg(F.sum(ok).alias("ok"), F.count("*").alias("n"))
    earlier = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("strategy", "day", F.coalesce(F.sum("ok").over(earlier), F.lit(0)).alias("ok0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    run = own.join(carried, ["strategy", "day"]).select("strategy", (F.col("n") + F.col("n0")).alias("n"), ((F.col("ok") + F.col("ok0")) / (F.col("n") + F.col("n0"))).alias("rate"))
    return run.groupBy("strategy").agg(F.count_if((F.col("n") >= least) & (F.col("rate") < low)).alias("alerts"), F.round(F.max_by("rate", "n"), 6).alias("last_rate"), F.max("n").alias("n"))


#: Tokens a second and most tokens of each strategy; others have the default.
RATES = {"click": (1 / 60, 5.0), "view": (1 / 120, 8.0)}
DEFAULT_RATE = (1 / 300, 2.0)


def token_bucket(attempts: DataFrame, rates: dict[str, tuple[float, float]] = RATES, default: tuple[float, float] = DEFAULT_RATE) -> DataFrame:
    """(event_id, strategy, t, granted): a bucket for each strategy over the whole log, refilled with time up to its capacity, full at first.

    After a pause that fills any bucket of that size the state is known: the log is cut there (see breaker_states()).
    """
    named = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    own = F.coalesce(F.element_at(named, F.col("strategy")), F.array(F.lit(default[0]), F.lit(default[1])))
    full = F.col("previous").isNull() | ((F.col("t") - F.col("previous")) * F.col("rate") >= F.col("capacity"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, 0.0, 0.0
        for batch in batches:
            granted = []
            for k, t, rate, capacity in zip(batch["key"], batch["t"], batch["rate"], batch["capacity"], strict=True):
                if key != k:
                    key, tokens, last = k, capacity, t
                tokens, last = min(capacity, tokens + (t - last) * rate), t
                granted.append(tokens >= 1)
                tokens -= granted[-1]
            yield pd.DataFrame({"event_id": batch["event_id"], "strategy": batch["strategy"], "t": batch["t"], "granted": granted})

    cut = _segments(attempts, full, after=False, rate=F.get(own, 0), capacity=F.get(own, 1))
    return _folded(cut).mapInPandas(run, "event_id long, strategy string, t double, granted boolean")


def url_checks(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with looks_pdf and paywall."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return urls.withColumn("looks_pdf", F.contains(low, F.lit(".pdf")) | (F.contains(low, F.lit("pdf")) & F.contains(low, F.lit("download")))).withColumn("paywall", low.rlike("login|subscribe|paywall|access-denied|forbidden"))


def response_checks(rows: DataFrame) -> DataFrame:
    """rows (url, content_type, content_length) with looks_pdf, paywall, pdf_type and size_ok (over 10,000 bytes, or unknown)."""
    pdf_type = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("pdf"))
    return url_checks(rows).withColumn("pdf_type", pdf_type).withColumn("size_ok", F.coalesce(F.col("content_length") > 10_000, F.lit(True)))


def health(attempts: DataFrame, threshold: int = 3, timeout_s: float = 300.0) -> DataFrame:
    """(strategy, available, rate, failures): available unless the breaker was open at the last attempt."""
    states = breaker_states(attempts, threshold, timeout_s).groupBy("strategy").agg((F.max_by("state", F.struct("t", "event_id")) != "open").alias("available"))
    return states.join(attempts.groupBy("strategy").agg(F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.count_if(~F.col("success")).alias("failures")), ["strategy"])


def valid_payload(content: Column) -> tuple[Column, Column]:
    """(is_pdf, no_paywall): 1024 bytes or more that start with %PDF; no paywall mark in the first 2048."""
    is_pdf = (F.octet_length(content) >= 1024) & F.startswith(content, F.lit("%PDF"))
    head = F.lower(F.substring(content, 1, 2048))
    return is_pdf, ~head.rlike("<html|<!doctype|access denied|subscription required|paywall")

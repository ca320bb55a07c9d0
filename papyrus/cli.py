"""Batch jobs for spark-submit: papers with abstracts, full analysis (also as a stream of events), pages to Markdown.

    spark-submit -m papyrus.cli abstracts --data DIR --out DIR [--term WORD] [--limit N]
    spark-submit -m papyrus.cli full --data DIR --out DIR [--streaming]
    spark-submit -m papyrus.cli markdown --data DIR --out DIR
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators import corpus, frequency, ingest, sentiment
from papyrus.session import get_spark
from papyrus.sources.views import papers, table
from papyrus.streaming import events


def abstracts(spark: SparkSession, data: str, term: str = "", limit: int = 100) -> dict[str, DataFrame]:
    """Papers that hold the term, and the coverage of all of them."""
    own = papers(spark, data)
    stats = corpus.coverage(own)
    return {"papers": corpus.search(own, term, limit), "coverage": stats, "suggestions": corpus.coverage_suggestions(stats)}


def full(spark: SparkSession, data: str, streaming: bool = False) -> dict[str, DataFrame]:
    """Coverage, terms by journal, tf-idf and sentiment of all papers; with streaming also the attempt log by the hour."""
    own = papers(spark, data)
    found = {"coverage": corpus.coverage(own), "terms": frequency.top_terms_by_journal(own), "tfidf": frequency.tfidf(own), "sentiment": sentiment.sentiment(own)}
    return found | ({"attempts": events.run(events.tumbling(events.source(spark, data)))} if streaming else {})


def markdown(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    """All pages as Markdown, those too short left out, and how many were converted."""
    pages = table(spark, data, "pages")
    done = ingest.markdown(pages)
    rate = pages.join(done.select("page_id", F.lit(True).alias("ok")), ["page_id"], "left").agg(F.count("*").alias("files"), F.count("ok").alias("converted"))
    return {"markdown": done, "conversion": rate}


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="papyrus", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("abstracts", "full", "markdown"):
        job = jobs.add_parser(name)
        job.add_argument("--data", required=True)
        job.add_argument("--out", required=True)
    jobs.choices["abstracts"].add_argument("--term", default="")
    jobs.choices["abstracts"].add_argument("--limit", type=int, default=100)
    jobs.choices["full"].add_argument("--streaming", action="store_true")
    given = vars(parser.parse_args(args))
    job, data, out = given.pop("job"), given.pop("data"), given.pop("out")
    session = spark or get_spark(f"papyrus {job}")
    for name, found in {"abstracts": abstracts, "full": full, "markdown": markdown}[job](session, data, **given).items():
        found.write.mode("overwrite").json(f"{out}/{name}")


if __name__ == "__main__":
    main()

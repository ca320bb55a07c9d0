"""Articles from documents of article XML: one parse of each document, whatever it asks for.

Abstracts mix text with markup and need each part's own label, which the built-in XML functions do not keep together, so a
small helper reads a document in an Arrow batch.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# English month names, and what an abstract in running text starts and ends with.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
HEADED = [rf"(?is){name}[:\s]+(.*?)(?:Keywords|Introduction|Background|Methods|PMID|$)" for name in ("Abstract", "Summary")]
LEAST_ABSTRACT, LEAST_HEADED, MOST_HEADED = 20, 50, 1000

ARTICLE = "pmid string, title string, abstract string, authors array<string>, journal string, pub_date date, doi string, error string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.date32(), pa.string(), pa.string()]


def _text(element: ElementTree.Element | None) -> str | None:
    """All text of an element, nested markup included; None where there is none."""
    return ("".join(element.itertext()).strip() or None) if element is not None else None


def _labelled(article: ElementTree.Element) -> list[str]:
    parts = [(e.get("Label"), _text(e)) for e in article.iter("AbstractText")]
    return [f"{label}: {text}" if label else text for label, text in parts if text]


def _other(article: ElementTree.Element) -> list[str]:
    return [f"[{e.get('Type', 'Other')}] {text}" for e in article.iter("OtherAbstract") if (text := _text(e))]


def _headed(article: ElementTree.Element) -> list[str]:
    running = "".join(article.itertext())
    found = (m[1].strip() for m in (re.search(p, running) for p in HEADED) if m)
    return [f[:MOST_HEADED] for f in found if len(f) > LEAST_HEADED][:1]


def abstract_of(article: ElementTree.Element) -> str | None:
    """The first of: the abstract's labelled parts, the abstract itself, other abstracts with their types, what a heading in the text announces. White space is one space; under 20 characters there is none."""
    parts = _labelled(article) or [t for e in [article.find(".//Abstract")] if (t := _text(e))] or _other(article) or _headed(article)
    joined = re.sub(r"\s+", " ", " ".join(parts)).strip()
    return joined if len(joined) >= LEAST_ABSTRACT else None


def date_of(article: ElementTree.Element) -> datetime.date | None:
    """Of PubDate or else ArticleDate, the first with a year: month as a number or a name (else 1), day (else 1); None if there is no such day."""
    for element in (article.find(".//PubDate"), article.find(".//ArticleDate")):
        year = element.findtext("Year") if element is not None else None
        if year is None:
            continue
        month, day = element.findtext("Month") or "1", element.findtext("Day") or "1"
        month = month if month.strip().isdigit() else 1 + MONTHS.index(month) if month in MONTHS else 1
        try:
            return datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
    return None


def authors_of(article: ElementTree.Element) -> list[str]:
    """Each author with a last name: first names and last name, or the last name alone."""
    people = [(a.findtext("ForeName"), a.findtext("LastName")) for a in article.iterfind(".//AuthorList/Author")]
    return [f"{fore} {last}" if fore else last for fore, last in people if last]


def parse_article(element: ElementTree.Element) -> tuple:
    pmid, article = element.findtext(".//PMID") or "", element.find(".//Article")
    if article is None:
        return pmid, None, None, [], None, None, None, "No article citation found"
    doi = next((e.text for e in element.iter("ArticleId") if e.get("IdType") == "doi"), None)
    return pmid, _text(article.find(".//ArticleTitle")), abstract_of(article), authors_of(article), article.findtext(".//Journal/Title"), date_of(article), doi, None


#: What an article that is not well-formed says in its error column.
MALFORMED = "Malformed article"


def parse_document(xml: str | None) -> list[tuple]:
    """The articles of a document, in order; one error row for a document that is not well-formed, none for a null or empty one."""
    try:
        return [parse_article(e) for e in ElementTree.fromstring(xml).iter("PubmedArticle")] if xml else []
    except ElementTree.ParseError:
        return [(None, None, None, [], None, None, None, MALFORMED)]


def parse_documents(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """rows with documents of many PubmedArticle -> one row an article: ARTICLE. A malformed document gives a row with an error, a null one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ARTICLE.split(", ")]
        for batch in batches:
            found = [a for doc in batch.column(0).to_pylist() for a in parse_document(doc)]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)

    return rows.select(xml).mapInArrow(run, ARTICLE)


RECORD_TAG = "PubmedArticle"


def write_archive(documents: DataFrame, path: str, xml: str = "xml") -> None:
    """Writes documents of articles, without their outer element, as files that hold many of them."""
    documents.select(xml).write.text(path)


def read_records(spark: SparkSession, path: str, tag: str = RECORD_TAG) -> DataFrame:
    """(record, whole) of every element ``tag`` in files of any size: a file is split between tasks, as its end tags separate the lines that Spark's text reader cuts it into.

    Where another start tag comes before the end tag the first one's element was never closed: what stands before it is a record
    that is not whole. Text outside of elements is left out. An element that the end of a file cuts off is closed there.
    """
    end = f"</{tag}>"
    pieces = spark.read.option("lineSep", end).text(path).select(F.split("value", rf"(?=<{tag}[\s>])").alias("p"))
    each = pieces.select(F.posexplode("p").alias("k", "record"), F.size("p").alias("n")).where(F.col("record").startswith(f"<{tag}"))
    whole = F.col("k") == F.col("n") - 1
    return each.select(F.when(whole, F.concat("record", F.lit(end))).otherwise(F.rtrim("record", F.lit(" \t\r\n"))).alias("record"), whole.alias("whole"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """ARTICLE and malformed of every record of an archive: a record that is not whole or not well-formed has an error and stands in malformed as it is; others have a null there."""
    names = [*(c.split()[0] for c in ARTICLE.split(", ")), "malformed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for record, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parsed = parse_document(record if whole else "<")
                found += [(*row, record if row[-1] == MALFORMED else None) for row in parsed]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*_TYPES, pa.string()], strict=True)], names)

    return read_records(spark, path).mapInArrow(run, f"{ARTICLE}, malformed string")

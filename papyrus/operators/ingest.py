"""Parsing of conversion and lookup JSON, access records and web pages, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an abstract in running text starts and ends with.
FALLBACK_PATTERNS = [r"(?is)Abstract[:\s]+(.*?)(?:Keywords|Introduction|Background|Methods|PMID|$)", r"(?is)Summary[:\s]+(.*?)(?:Keywords|Introduction|Background|Methods|PMID|$)"]


def escaped(text: Column) -> Column:
    """Text as XML content; control characters that XML has no place for become spaces."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", " ")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def parse_conversions(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with {"records": [{"pmid", "pmcid"}]} -> (pmid, pmcid) of the records that have both, with the PMC prefix."""
    parsed = F.from_json(F.col(json), "struct<records: array<struct<pmid: string, pmcid: string>>>")
    one = rows.select(F.explode(parsed["records"]).alias("r")).select("r.pmid", "r.pmcid").where("pmid is not null and pmcid is not null and pmcid <> ''")
    return one.select("pmid", F.when(F.upper("pmcid").startswith("PMC"), F.col("pmcid")).otherwise(F.concat(F.lit("PMC"), "pmcid")).alias("pmcid"))


def first_link(json: Column) -> Column:
    return F.get_json_object(json, "$.linksets[0].linksetdbs[0].links[0]")


def parse_access(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Access records: licence, whether retracted, and the first pdf link with https; null link for an error record."""
    x = F.col(xml)
    link = F.get(F.xpath(x, F.lit("//link[contains(translate(@format,'PDF','pdf'),'pdf')]/@href")), 0)
    bad = F.xpath_boolean(x, F.lit("boolean(//error)"))
    return rows.select(
        F.nullif(F.xpath_string(x, F.lit("//record/@license")), F.lit("")).alias("license"), (F.xpath_string(x, F.lit("//record/@retracted")) == "yes").alias("retracted"),
        F.when(~bad, F.regexp_replace(link, "^ftp://", "https://")).alias("pdf_url"),
    )


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_paragraphs, n_links, n_bytes) by patterns."""
    h = F.coalesce("html", F.lit(""))

    def element(tag: str) -> Column:
        return F.regexp_extract(h, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)

    return pages.select("page_id", element("title").alias("title"), element("h1").alias("heading"), F.regexp_count(h, F.lit(r"<p[ >]")).alias("n_paragraphs"), F.regexp_count(h, F.lit(r"<a ")).alias("n_links"), F.octet_length(h).alias("n_bytes"))


#: Markup to Markdown, step by step; $1 and $2 are groups.
MARKDOWN = [
    (r"(?s)<script\b.*?</script>", ""), (r"(?s)<style\b.*?</style>", ""), (r"(?s)<head\b.*?</head>", ""), (r"(?s)<!--.*?-->", ""), *[(rf"<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?s)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"), (r"</?(?:b|strong)>", "**"), (r"</?(?:i|em)>", "*"), (r"(?s)<(?:ul|ol)[^>]*>\s*<li[^>]*>", "\n- "), (r"<li[^>]*>", "\n- "), (r"<(?:p|br|div|/ul|/ol)[^>]*>", "\n"), (r"<[^>]+>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), (r"[ \t]+", " "), (r"\s*\n\s*", "\n"),
]


def markdown(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, markdown) of the pages whose Markdown has more than ``least`` bytes: headings, paragraphs, lists, links, emphasis and common references; other markup is dropped."""
    t = F.coalesce("html", F.lit(""))
    for pattern, to in MARKDOWN:
        t = F.regexp_replace(t, pattern, to)
    return pages.select("page_id", F.trim(t).alias("markdown")).where(F.octet_length("markdown") > least)


def sink_statistics(rows: DataFrame, content: str) -> DataFrame:
    """One row: files and their total size in MiB."""
    return rows.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)) / 1048576, 2).alias("total_mb"))


def recover_abstract(markup: Column) -> Column:
    """First <abstract> body, else the AbstractText bodies joined by spaces, else what follows an Abstract or Summary heading (over 50 characters, cut to 1000); null without any."""
    first = F.trim(F.regexp_extract(markup, r"(?is)<abstract[^>t]*>(.*?)</abstract>", 1))
    texts = F.array_join(F.regexp_extract_all(markup, F.lit(r"(?is)<abstracttext[^>]*>(.*?)</abstracttext>"), F.lit(1)), " ")
    headed = [F.trim(F.regexp_extract(markup, p, 1)) for p in FALLBACK_PATTERNS]
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(texts, F.lit("")), *[F.when(F.length(h) > 50, F.substring(h, 1, 1000)) for h in headed])

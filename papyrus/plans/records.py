"""Queries over records, lookups, prompts and request logs, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators import articles, attempts as A, corpus, ingest, lookups, prompts, retrieval, scoring
from papyrus.session import shared_folder
from papyrus.sources.views import attempts, dated_papers, papers, scores, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _num(column: str = "doc_id") -> Column:
    return F.col(column).cast("string")


NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _article_xml() -> Column:
    """A document of two articles: a paper in one of seven forms of abstract and three of authors, then one without a citation; every eighth document is cut off."""
    n, t = F.col("doc_id"), ingest.escaped(F.col("abstract"))
    k, who, when = n % 8, n % 3, n % 4

    def xml(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    abstract = (
        F.when(k == 0, xml("<Abstract><AbstractText>", t, "</AbstractText><AbstractText Label='B'>second part</AbstractText></Abstract>"))
        .when(k == 1, xml("<Abstract><AbstractText Label='A'>", t, "<i> nested</i> end</AbstractText></Abstract>"))
        .when(k == 2, xml("<Abstract>", t, "</Abstract>"))
        .when(k == 3, xml("<OtherAbstract Type='Translated'>", t, "</OtherAbstract><OtherAbstract>other</OtherAbstract>"))
        .when(k == 4, xml("<Note>Abstract: ", F.expr("repeat('word ', 12)"), "Keywords: x</Note>"))
        .when(k == 5, F.lit("<Abstract><AbstractText>1234567890123456789</AbstractText></Abstract>"))
        .otherwise(F.lit("<Abstract><AbstractText>12345678901234567890</AbstractText></Abstract>"))
    )
    smith, doe = xml("<Author><LastName>Smith</LastName><ForeName>A", n.cast("string"), "</ForeName></Author>"), F.lit("<Author><LastName>Doe</LastName></Author>")
    people = F.when(who == 0, F.concat(doe, smith)).when(who == 1, F.concat(smith, doe)).otherwise(xml("<Author><CollectiveName>Group</CollectiveName></Author>", smith))
    day = xml("<Day>", (n % 31 + 1).cast("string"), "</Day>")
    month = F.when(when == 0, (n % 12 + 1).cast("string")).when(when == 1, F.get(F.array(*map(F.lit, articles.MONTHS)), (n % 12).cast("int"))).otherwise("Spring")
    year = xml("<Year>", (2000 + n % 20).cast("string"), "</Year>")
    date = F.when(when == 3, xml("<PubDate><MedlineDate>x</MedlineDate></PubDate><ArticleDate>", year, "<Month>2</Month>", day, "</ArticleDate>")).otherwise(xml("<PubDate>", year, "<Month>", month, "</Month>", day, "</PubDate>"))
    doi = F.when(n % 2 == 0, xml("<ArticleId IdType='pubmed'>1</ArticleId><ArticleId IdType='doi'>10.1/", n.cast("string"), "</ArticleId><ArticleId IdType='doi'>10.2/z</ArticleId>")).otherwise("")
    whole = xml(
        "<Set><PubmedArticle><PMID>", n.cast("string"), "</PMID><Article><Journal><Title>", ingest.escaped(F.col("journal")), "</Title></Journal>", date, "<ArticleTitle>", ingest.escaped(F.col("title")), "</ArticleTitle>", abstract,
        "<AuthorList>", people, "</AuthorList></Article><ArticleIdList>", doi, "</ArticleIdList></PubmedArticle><PubmedArticle><PMID>x", n.cast("string"), "</PMID></PubmedArticle></Set>",
    )
    return F.when(k == 7, F.substring(whole, F.lit(1), F.length(whole) - 8)).otherwise(whole)


@query(f"""
    WITH p AS (SELECT doc_id AS n, text, split_part(text, chr(10), 1) AS title, source FROM documents WHERE doc_id % 8 <> 7),
    a AS (SELECT n, title, source, trim(CASE n % 8
            WHEN 0 THEN {NORM.format("text")} || ' B: second part' WHEN 1 THEN 'A: ' || {NORM.format("text || ' nested end'")}
            WHEN 2 THEN {NORM.format("text")} WHEN 3 THEN '[Translated] ' || {NORM.format("text")} || ' [Other] other'
            WHEN 4 THEN trim(repeat('word ', 12)) WHEN 5 THEN '1234567890123456789' ELSE '12345678901234567890' END) AS a FROM p)
    SELECT CAST(n AS VARCHAR) AS pmid, nullif({NORM.format("title")}, '') AS title, CASE WHEN length(a) >= 20 THEN length(a) END AS n_abstract, CASE WHEN length(a) >= 20 THEN md5(a) END AS md5,
        CASE n % 3 WHEN 0 THEN 'Doe; A' || n || ' Smith' WHEN 1 THEN 'A' || n || ' Smith; Doe' ELSE 'A' || n || ' Smith' END AS authors, source AS journal,
        TRY_CAST(printf('%d-%02d-%02d', CAST(2000 + n % 20 AS BIGINT), CASE WHEN n % 4 = 3 THEN 2 WHEN n % 4 = 2 THEN 1 ELSE n % 12 + 1 END, n % 31 + 1) AS DATE) AS pub_date,
        CASE WHEN n % 2 = 0 THEN '10.1/' || n END AS doi, NULL AS error FROM a
    UNION ALL SELECT 'x' || n, NULL, NULL, NULL, '', NULL, NULL, NULL, 'No article citation found' FROM a
    UNION ALL SELECT NULL, NULL, NULL, NULL, '', NULL, NULL, NULL, 'Malformed article' FROM documents WHERE doc_id % 8 = 7
""")
def article_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper as a document of article XML, parsed: nested, labelled, other and missing abstracts, authors without first names, odd dates, malformed documents."""
    found = articles.parse_documents(papers(spark, sf_dir).select(_article_xml().alias("xml")))
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    return found.select("pmid", title.alias("title"), F.length("abstract").alias("n_abstract"), F.md5("abstract").alias("md5"), F.array_join("authors", "; ").alias("authors"), "journal", "pub_date", "doi", "error")


@query("""
    SELECT o_orderkey AS pmid, CAST(o_orderdate AS DATE) AS pub_date, o_orderpriority AS journal FROM orders
    WHERE contains(lower(o_orderpriority), 'high') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' ORDER BY o_orderkey LIMIT 40 OFFSET 10
""")
def search_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.search_dates(dated_papers(spark, sf_dir), "journal", "high", "1996/03/01", "1998/06/30", 40, 10)


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT true AS with_key, least(200, greatest(50, n // 5)) AS size FROM n UNION ALL SELECT false, least(100, greatest(20, n // 10)) FROM n),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
    SELECT with_key, r // size AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r, s GROUP BY 1, 2
""")
def batch_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the size that the number of ids asks for, with and without an access key."""
    p = papers(spark, sf_dir)
    n = p.count()
    with_key, without = (corpus.batches(p, corpus.batch_size(n, key)).select(F.lit(key).alias("with_key"), "batch", "n", "first_id", "last_id") for key in (True, False))
    return with_key.unionByName(without)


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT true AS with_key, least(200, greatest(100, n)) AS size FROM n UNION ALL SELECT false, least(100, greatest(50, n)) FROM n), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
    SELECT with_key, r // size AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r, s GROUP BY 1, 2
""")
def conversion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids in batches of the size that conversion requests take, with and without an access key."""
    p = papers(spark, sf_dir)
    n = p.count()
    with_key, without = (corpus.batches(p, corpus.conversion_batch(n, key)).select(F.lit(key).alias("with_key"), "batch", "n", "first_id", "last_id") for key in (True, False))
    return with_key.unionByName(without)


_TYPE = "CASE WHEN {m} THEN 'methodological' WHEN {f} THEN 'findings' WHEN {t} THEN 'temporal' WHEN {l} THEN 'limitations' WHEN {u} THEN 'future_work' ELSE 'general' END"


def _any(words: str, col: str = "q") -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words.split(",")) + ")"


QUESTION_TYPE = _TYPE.format(m=_any("method,approach,technique,how"), f=_any("finding,result,discover,show"), t=_any("trend,evolution,change,over time"), l=_any("limitation,challenge,problem,gap"), u=_any("future,next,recommend,suggest"))
#: User turns, every one of them given one of nine words that questions ask by.
ASKED = "asked AS (SELECT conv_id, turn, lower(text || ' ' || ['how', 'results', 'trends', 'gaps', 'next', 'thematic', '', 'why', 'show methods'][CAST(conv_id % 9 AS INTEGER) + 1]) AS q FROM conversations WHERE role = 'user')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, ["how", "results", "trends", "gaps", "next", "thematic", "", "why", "show methods"])), (F.col("conv_id") % 9).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" "), word).alias("question"))


@query(f"""
    WITH {ASKED}, t AS (SELECT conv_id, turn, {QUESTION_TYPE} AS type FROM asked)
    SELECT conv_id, turn, type, CASE type WHEN 'methodological' THEN 'section,fulltext,abstract' WHEN 'findings' THEN 'abstract,section,fulltext' ELSE 'abstract,fulltext,section' END AS targets, 1 AS limit_each FROM t
""")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with its type, the indexes that are searched for it in order, and how many contexts each may give."""
    return retrieval.classify(_asked(spark, sf_dir)).select("conv_id", "turn", "type", F.array_join("targets", ",").alias("targets"), "limit_each")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'PMC' || (doc_id * 3) END AS pmcid FROM labels")
def cross_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.when(F.col("quality") == 1, F.array((F.col("doc_id") * 3).cast("string"), F.lit("7"))).otherwise(F.array().cast("array<string>"))
    json = F.to_json(F.struct(F.struct(ids.alias("idlist")).alias("esearchresult")))
    return table(spark, sf_dir, "labels").select("doc_id", lookups.cross_search_id(json).alias("pmcid"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://a/' || doc_id WHEN quality = 1 THEN 'https://b/' || doc_id END AS link FROM labels")
def free_pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    num, n = _num(), F.col("doc_id")
    paper = F.when(n % 3 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("https://a/"), num).alias("url")).alias("openAccessPdf")))).when(n % 3 == 1, F.lit('{"openAccessPdf": null}')).otherwise(F.lit('{"openAccessPdf": {"url": ""}}'))
    location = F.to_json(F.struct((F.col("quality") == 1).alias("is_oa"), F.struct(F.concat(F.lit("https://b/"), num).alias("url_for_pdf")).alias("best_oa_location")))
    return table(spark, sf_dir, "labels").select("doc_id", lookups.open_access_link(paper, location).alias("link"))


@query("SELECT doc_id // 50 AS batch, CASE WHEN sum(quality) % 3 = 0 THEN 'abstract' WHEN sum(toxic) % 2 = 0 THEN 'medline' ELSE 'plain' END AS source, count(*) AS n FROM labels GROUP BY 1")
def metadata_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ids whose three sources fail or not; the first that does not is taken."""
    by = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(F.sum("quality").alias("q"), F.sum("toxic").alias("t"), F.count("*").alias("n"))
    sources = F.array(F.struct(F.lit(0).alias("priority"), F.lit("abstract").alias("source"), (F.col("q") % 3 == 0).alias("ok")), F.struct(F.lit(1).alias("priority"), F.lit("medline").alias("source"), (F.col("t") % 2 == 0).alias("ok")), F.struct(F.lit(2).alias("priority"), F.lit("plain").alias("source"), F.lit(True).alias("ok")))
    return lookups.first_answer(by.select("batch", "n", F.explode(sources).alias("s")).select("batch", "n", "s.*"), "batch", F.col("priority"), F.col("ok")).select("batch", "source", "n")


@query("""
    WITH r AS (SELECT doc_id // 200 AS batch, doc_id, quality, toxic FROM labels),
    a AS (SELECT batch, doc_id, 1 AS o, 'medline' AS source, 'm ' || doc_id AS abstract FROM r WHERE toxic = 1 AND batch % 2 = 0 UNION ALL SELECT batch, doc_id, 2, 'full', 'f ' || doc_id FROM r WHERE quality = 0)
    SELECT batch, CAST(doc_id AS VARCHAR) AS pmid, source, abstract FROM a WHERE o = (SELECT min(o) FROM a b WHERE b.batch = a.batch)
""")
def alternative_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing abstracts of each two hundred ids, asked of two sources in order; a batch stops at the first that gives any, for whichever of its ids."""
    numbered = table(spark, sf_dir, "labels").withColumn("batch", F.floor(F.col("doc_id") / 200))
    medline, full = F.when((F.col("toxic") == 1) & (F.col("batch") % 2 == 0), F.concat(F.lit("m "), _num())), F.when(F.col("quality") == 0, F.concat(F.lit("f "), _num()))
    both = F.explode(F.array(F.struct(F.lit("full").alias("source"), full.alias("abstract")), F.struct(F.lit("medline").alias("source"), medline.alias("abstract"))))
    return lookups.first_yielding_source(numbered.select("batch", _num().alias("pmid"), both.alias("a")).select("batch", "pmid", "a.*"), ["medline", "full", "plain"])


@query("""
    WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'PMID:' || doc_id END AS pmid, CASE WHEN doc_id % 3 = 0 THEN 'PMC' || doc_id END AS pmcid, coalesce(split_part(text, chr(10), 1), '') AS title FROM documents)
    SELECT doc_id, coalesce(pmid, 'unknown_' || md5(title)) AS paper_id, coalesce(pmcid, pmid, 'unknown_' || md5(title)) AS map_key, CASE WHEN doc_id % 3 = 0 THEN 'PMC' || doc_id WHEN pmid IS NOT NULL THEN 'pmid_' || doc_id ELSE 'unknown_' || md5(title) END || '.md' AS file FROM p
""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    own = papers(spark, sf_dir).select("doc_id", F.when(n % 4 != 3, F.col("pmid")).alias("pmid"), F.when(n % 3 == 0, F.concat(F.lit("PMC"), _num())).alias("pmcid"), "title")
    return lookups.output_names(own).select("doc_id", "paper_id", "map_key", "file")


@query("""
    WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '.pdf' WHEN 1 THEN 'a' || page_id || '.PDF' WHEN 2 THEN 'a' || page_id || '.txt' ELSE 'd' || page_id || '.pdf' END AS path, CASE WHEN page_id % 8 IN (0, 1) THEN 0 ELSE strlen(html) END AS length FROM pages)
    SELECT page_id, path, length FROM f WHERE page_id % 4 IN (0, 1)
""")
def pdf_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a listing of files with other endings, upper-case endings, empty files and folders."""
    n = F.col("page_id")
    path = F.when(n % 4 == 0, F.concat(F.lit("a"), _num("page_id"), F.lit(".pdf"))).when(n % 4 == 1, F.concat(F.lit("a"), _num("page_id"), F.lit(".PDF"))).when(n % 4 == 2, F.concat(F.lit("a"), _num("page_id"), F.lit(".txt"))).otherwise(F.concat(F.lit("d"), _num("page_id"), F.lit(".pdf")))
    length = F.when((n % 8).isin(0, 1), 0).otherwise(F.octet_length("html"))
    return lookups.pdf_listing(table(spark, sf_dir, "pages").select("page_id", path.alias("path"), length.alias("length"), (n % 4 == 3).alias("is_folder"))).drop("is_folder")


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) AS has_file FROM documents")
def papers_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(_num(), F.lit(".pdf")))
    listing = table(spark, sf_dir, "labels").select(F.concat(_num(), F.lit(".pdf")).alias("path"))
    return lookups.with_files(papers(spark, sf_dir).select("doc_id", path.alias("path")), listing).select("doc_id", "has_file")


@query("""
    WITH s AS (SELECT d.doc_id, source, lang, 'quality ' || quality AS response, CAST(quality * 4 + d.doc_id % 7 AS DOUBLE) AS overall, n_chars / 1000.0 AS seconds FROM labels l JOIN documents d USING (doc_id))
    SELECT lang AS analysis_type, count(*) AS n, round(avg(overall), 4) AS mean, md5(string_agg(doc_id || response, ',' ORDER BY doc_id)) AS md5 FROM s GROUP BY 1
""")
def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All responses and their scores written as JSON lines to the shared folder, then read back."""
    own = scores(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), "quality"), ["paper_id"])
    back = scoring.exported(own.select("paper_id", "analysis_type", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("response"), "scores", "seconds"), f"{shared_folder(spark)}/results")
    lines = F.array_sort(F.collect_list(F.struct("paper_id", F.concat(F.col("paper_id").cast("string"), "response").alias("line"))))
    return back.groupBy("analysis_type").agg(F.count("*").alias("n"), F.round(F.avg("scores.overall_quality"), 4).alias("mean"), F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), ",")).alias("md5"))


_RAG = "replace(replace(CASE type WHEN 'methodological' THEN '" + "' WHEN 'findings' THEN '".join(prompts.TEMPLATES[k] for k in ("methodological", "findings")) + "' ELSE '" + prompts.TEMPLATES["general"] + "' END, '{question}', q), '{context}', coalesce(c, ''))"


@query(f"""
    WITH {ASKED}, c AS (SELECT conv_id, turn - 1 AS turn, text AS c FROM conversations WHERE role <> 'user'), t AS (SELECT asked.*, {QUESTION_TYPE} AS type, c FROM asked LEFT JOIN c USING (conv_id, turn))
    SELECT conv_id, turn, length({_RAG}) AS n_chars, md5({_RAG}) AS md5 FROM t
""")
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question, in lower case, with the next turn as context, in the template of its type."""
    context = table(spark, sf_dir, "conversations").where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("c"))
    typed = retrieval.classify(_asked(spark, sf_dir)).withColumn("q", F.lower("question")).join(context, ["conv_id", "turn"], "left")
    prompt = prompts.rag_prompt(F.col("type"), F.col("q"), F.col("c"))
    return typed.select("conv_id", "turn", F.length(prompt).alias("n_chars"), F.md5(prompt).alias("md5"))


_PAPERS = "string_agg('Paper ' || r || chr(10) || 'Title: ' || title || chr(10) || 'Abstract: ' || CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END, chr(10) ORDER BY r)"


@query(
    f"WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, split_part(text, chr(10), 1) AS title, text FROM documents QUALIFY r <= 10), l AS (SELECT {_PAPERS} AS l, (SELECT count(*) FROM documents) AS n FROM d), "
    "t(aspect, t) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in prompts.COMPARISONS.items()) + "), "
    "p AS (SELECT aspect, replace(replace(t, '{n}', CAST(n AS VARCHAR)), '{papers}', l) AS p FROM t, l) SELECT aspect, length(p) AS n_chars, md5(p) AS md5 FROM p"
)
def comparative_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.comparative_prompts(papers(spark, sf_dir)).select("aspect", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("md5"))


@query("""
    WITH k AS (SELECT lang || CASE doc_id % 3 WHEN 0 THEN '_comparative' WHEN 1 THEN '_insight' ELSE '_summary' END AS kind FROM documents)
    SELECT kind, CASE WHEN contains(kind, 'summary') THEN 'small' ELSE 'large' END AS model, CASE WHEN contains(kind, 'comparative') THEN 800 ELSE 500 END AS tokens, count(*) AS n FROM k GROUP BY 1, 2, 3
""")
def model_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    kinds = papers(spark, sf_dir).select(F.concat("keyword", F.when(n == 0, "_comparative").when(n == 1, "_insight").otherwise("_summary")).alias("kind"))
    model, tokens = prompts.model_settings(F.col("kind"))
    return kinds.groupBy("kind", model.alias("model"), tokens.alias("tokens")).agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT d.doc_id AS paper_id, CAST(quality * 4 + d.doc_id % 7 AS DOUBLE) AS q, CAST(10 - toxic * 5 - d.doc_id % 5 AS DOUBLE) AS c, CAST((d.doc_id % 11) * 0.9 AS DOUBLE) AS i FROM labels l JOIN documents d USING (doc_id)),
    k AS (SELECT round((0.25 * q + 0.10 * c + 0.20 * i) / 0.55, 6) * 10 AS x FROM s) SELECT CASE WHEN x >= 75 THEN 'high' WHEN x >= 50 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM k GROUP BY 1
""")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = scoring.composites(scores(spark, sf_dir))
    return ranking.groupBy(prompts.quality_bucket(F.col("composite") * 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "WITH i(category, question) AS (VALUES " + ", ".join(f"('{c}', '{q}')" for c, q in prompts.INSIGHTS.items()) + """),
    w AS (SELECT DISTINCT category, w FROM (SELECT category, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS w FROM i) WHERE length(w) > 2), d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
    h AS (SELECT category, doc_id, count(*) AS shared FROM w JOIN d ON contains(t, w) GROUP BY 1, 2)
    SELECT category, 'analytical' AS type, CAST(row_number() OVER (PARTITION BY category ORDER BY shared DESC, doc_id) AS INTEGER) AS place, doc_id, shared FROM h QUALIFY place <= 10"""
)
def insight_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers that each insight question is answered from: those that hold most of its words."""
    return prompts.question_contexts(prompts.insight_questions(spark), papers(spark, sf_dir)).select("category", "type", "place", "doc_id", "shared")


CHUNKS = """RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, source FROM documents),
    w(doc_id, k, s, e) AS (
        SELECT doc_id, 0, 0, CASE WHEN 500 >= n THEN n ELSE coalesce(nullif(250 + length(regexp_extract(substr(t, 251, 251), '(?s)^(.*[.!?])', 1)), 250), 500) END FROM d WHERE n > 0
        UNION ALL
        SELECT doc_id, k + 1, x, CASE WHEN x + 500 >= n THEN n ELSE x + coalesce(nullif(250 + length(regexp_extract(substr(t, x + 251, 251), '(?s)^(.*[.!?])', 1)), 250), 500) END
        FROM (SELECT w.doc_id, k, greatest(e - 50, s + 1) AS x, e, t, n FROM w JOIN d USING (doc_id) WHERE e < n)),
    c AS (SELECT doc_id, k AS chunk_id, s AS start, substr(t, s + 1, e - s) AS text, source FROM w JOIN d USING (doc_id) WHERE length(trim(regexp_replace(substr(t, s + 1, e - s), '\\s+', ' ', 'g'))) > 50)"""


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM c GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(papers(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {CHUNKS} SELECT source AS journal, count(*) AS chunks, count(DISTINCT doc_id) AS papers, md5(string_agg('PMID:' || doc_id || ' ' || chunk_id || ' ' || start, ',' ORDER BY doc_id, chunk_id)) AS md5 FROM c GROUP BY 1")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its paper's fields; per journal, counts and a digest of ids, chunk numbers and starts."""
    p = papers(spark, sf_dir)
    own = prompts.chunk_metadata(retrieval.chunks(p), p)
    by_paper = own.groupBy("journal", "doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "start", "pmid"))), lambda c: F.concat_ws(" ", c["pmid"], c["chunk_id"], c["start"])), ",").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), ",")
    return by_paper.groupBy("journal").agg(F.sum("n").alias("chunks"), F.count("*").alias("papers"), F.md5(lines).alias("md5"))


ATTEMPTS = "att AS (SELECT event_id, event_type AS strategy, user_id AS paper, ts, value, value >= 10 AS success FROM events)"


@query(f"""
    WITH {ATTEMPTS}, f AS (SELECT paper, arg_min(strategy, {{'p': list_position(['click', 'view', 'purchase', 'signup', 'error'], strategy), 't': ts, 'e': event_id}}) AS strategy FROM att WHERE success GROUP BY 1)
    SELECT strategy, count(*) AS papers FROM f GROUP BY 1
""")
def strategy_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch's successful papers, how many each strategy delivered."""
    order = F.array_position(F.array(*map(F.lit, ["click", "view", "purchase", "signup", "error"])), F.col("strategy"))
    return A.first_success(attempts(spark, sf_dir), order).groupBy("strategy").agg(F.count("*").alias("papers"))


@query(f"""
    WITH {ATTEMPTS}, i AS (SELECT *, sum(CAST(success AS INTEGER)) OVER (PARTITION BY strategy ORDER BY ts, event_id) AS island FROM att), r AS (SELECT strategy, island, count(*) AS n FROM i WHERE NOT success GROUP BY ALL)
    SELECT strategy, max(n) AS longest, count(*) FILTER (n >= 3) AS opened, count(*) AS runs FROM r GROUP BY 1
""")
def breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.breaker_runs(attempts(spark, sf_dir))


@query(f"""
    WITH {ATTEMPTS}, w AS (SELECT strategy, avg(CAST(success AS INTEGER)) OVER x AS rate, count(*) OVER x AS n FROM att WINDOW x AS (PARTITION BY strategy ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT strategy, count(*) FILTER (n >= 20 AND rate < 0.82) AS alerts, round(arg_max(rate, n), 6) AS last_rate, max(n) AS n FROM w GROUP BY 1
""")
def running_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.running_rate(attempts(spark, sf_dir), 20, 0.82)


#: The breaker as a recursion over a strategy's attempts: f failures in a row so far, o the time it opened.
BREAKER = f"""RECURSIVE {ATTEMPTS}, a AS (SELECT *, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY strategy ORDER BY ts, event_id) AS r FROM att),
    s(strategy, r, event_id, t, success, f, o, state) AS (
        SELECT strategy, r, event_id, t, success, CASE WHEN success THEN 0 ELSE 1 END, CAST(NULL AS DOUBLE), 'closed' FROM a WHERE r = 1
        UNION ALL
        SELECT strategy, r, event_id, t, success, CASE WHEN state = 'open' THEN f WHEN success THEN 0 ELSE f + 1 END, CASE WHEN state = 'open' THEN o WHEN success THEN NULL WHEN f + 1 >= 3 THEN t ELSE o END, state
        FROM (SELECT a.strategy, a.r, a.event_id, a.t, a.success, s.f, s.o, CASE WHEN s.o IS NULL THEN 'closed' WHEN a.t - s.o < 300 THEN 'open' ELSE 'half-open' END AS state FROM s JOIN a ON a.strategy = s.strategy AND a.r = s.r + 1))"""


@query(f"WITH {BREAKER} SELECT strategy, state, count(*) AS n, min(event_id) AS first_event, CAST(sum(event_id) AS BIGINT) AS events FROM s GROUP BY 1, 2")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.breaker_states(attempts(spark, sf_dir))
    return found.groupBy("strategy", "state").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.sum("event_id").alias("events"))


@query(f"WITH {BREAKER} SELECT strategy, arg_max(state, r) <> 'open' AS available, round(avg(CAST(success AS INTEGER)), 6) AS rate, count(*) FILTER (NOT success) AS failures FROM s GROUP BY 1")
def strategy_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.health(attempts(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {ATTEMPTS}, a AS (SELECT strategy, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY strategy ORDER BY ts, event_id) AS r,
        CASE strategy WHEN 'click' THEN 1 / 60.0::DOUBLE WHEN 'view' THEN 1 / 120.0::DOUBLE ELSE 1 / 300.0::DOUBLE END AS rate, CASE strategy WHEN 'click' THEN 5.0::DOUBLE WHEN 'view' THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END AS cap FROM att),
    s(strategy, r, event_id, t, tokens, granted) AS (
        SELECT strategy, r, event_id, t, cap - 1, true FROM a WHERE r = 1
        UNION ALL
        SELECT strategy, r, event_id, t, CASE WHEN x >= 1 THEN x - 1 ELSE x END, x >= 1 FROM (SELECT a.strategy, a.r, a.event_id, a.t, least(a.cap, s.tokens + (a.t - s.t) * a.rate) AS x FROM s JOIN a ON a.strategy = s.strategy AND a.r = s.r + 1))
    SELECT strategy, granted, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM s GROUP BY 1, 2
""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.token_bucket(attempts(spark, sf_dir)).groupBy("strategy", "granted").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


STATUS = "CASE WHEN value < 10 THEN 429 WHEN value < 15 THEN 503 WHEN value < 17 THEN 404 ELSE 200 END"


@query(f"""
    WITH RECURSIVE q AS (SELECT user_id % 50 AS client, user_id AS request, event_id, ts, {STATUS} AS status, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS try, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS r FROM events),
    s(client, r, request, event_id, status, try, excess, used, delay) AS (
        SELECT client, r, request, event_id, status, try, CASE WHEN status = 429 THEN 1 ELSE 0 END, 1.0::DOUBLE, CASE WHEN status < 400 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END FROM q WHERE r = 1
        UNION ALL
        SELECT q.client, q.r, q.request, q.event_id, q.status, q.try, CASE WHEN q.status = 429 THEN s.excess + 1 WHEN q.status < 400 THEN greatest(0, s.excess - 1) ELSE s.excess END, s.delay, CASE WHEN q.status < 400 THEN greatest(0.2::DOUBLE, s.delay * 0.9::DOUBLE) ELSE s.delay END
        FROM s JOIN q ON q.client = s.client AND q.r = s.r + 1),
    x AS (SELECT *, (status = 429 AND try < 3) OR (status = 503 AND try < 2) AS again FROM s)
    SELECT client, CASE WHEN again THEN 'retry' WHEN status >= 400 THEN 'fail' ELSE 'done' END AS action, count(*) AS n, round(sum(CASE WHEN NOT again THEN 0 WHEN status = 429 THEN used * pow(2, try) * least(5.0, 1 + 0.5 * excess) ELSE 2.0 * (try + 1) END), 3) AS wait FROM x GROUP BY 1, 2
""")
def client_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the answers that fifty clients got; what each does next, and how long it waits."""
    v = F.col("value")
    status = F.when(v < 10, 429).when(v < 15, 503).when(v < 17, 404).otherwise(200)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("client"), F.col("user_id").alias("request"), "event_id", "ts", status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("try"))
    return lookups.backoff(rows).groupBy("client", "action").agg(F.count("*").alias("n"), F.round(F.sum("wait"), 3).alias("wait"))


URL = "CASE page_id % 6 WHEN 0 THEN url || '/a.PDF' WHEN 1 THEN url || '/download?f=pdf' WHEN 2 THEN url || '/login?next=x' WHEN 3 THEN url || '/paywall' ELSE url END"
CONTENT = "CASE page_id % 5 WHEN 0 THEN '%PDF-1.4 ' || repeat('x', 1015) WHEN 1 THEN '%PDF-1.4 ' || repeat('x', 1014) WHEN 2 THEN '%PDF ' || html WHEN 3 THEN '%PDF' || repeat('x', 2044) || 'paywall' ELSE '%PDF' || repeat('x', 2037) || 'Paywall' END"


@query(f"""
    WITH p AS (SELECT page_id, lower({URL}) AS u, CASE page_id % 3 WHEN 0 THEN 'application/PDF' WHEN 1 THEN 'text/html' END AS ctype, CASE WHEN page_id % 4 <> 0 THEN strlen(html) * 5 END AS size FROM pages)
    SELECT page_id, contains(u, '.pdf') OR (contains(u, 'pdf') AND contains(u, 'download')) AS looks_pdf, regexp_matches(u, 'login|subscribe|paywall|access-denied|forbidden') AS paywall,
        coalesce(contains(lower(ctype), 'pdf'), false) AS pdf_type, coalesce(size > 10000, true) AS size_ok FROM p
""")
def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses with endings of each kind, types and sizes."""
    k, url = F.col("page_id") % 6, F.col("url")
    address = F.when(k == 0, F.concat(url, F.lit("/a.PDF"))).when(k == 1, F.concat(url, F.lit("/download?f=pdf"))).when(k == 2, F.concat(url, F.lit("/login?next=x"))).when(k == 3, F.concat(url, F.lit("/paywall"))).otherwise(url)
    ctype = F.when(F.col("page_id") % 3 == 0, "application/PDF").when(F.col("page_id") % 3 == 1, "text/html")
    rows = table(spark, sf_dir, "pages").select("page_id", address.alias("url"), ctype.alias("content_type"), F.when(F.col("page_id") % 4 != 0, F.octet_length("html") * 5).alias("content_length"))
    return A.response_checks(rows).select("page_id", "looks_pdf", "paywall", "pdf_type", "size_ok")


@query(f"WITH c AS (SELECT page_id, {CONTENT} AS c FROM pages) SELECT page_id, strlen(c) >= 1024 AND starts_with(c, '%PDF') AS is_pdf, NOT regexp_matches(lower(left(c, 2048)), '<html|<!doctype|access denied|subscription required|paywall') AS no_paywall FROM c")
def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of 1023 and 1024 bytes, with a page's markup, and with a mark within and after the first 2048."""
    k = F.col("page_id") % 5
    content = F.when(k == 0, F.expr("'%PDF-1.4 ' || repeat('x', 1015)")).when(k == 1, F.expr("'%PDF-1.4 ' || repeat('x', 1014)")).when(k == 2, F.concat(F.lit("%PDF "), "html")).when(k == 3, F.expr("'%PDF' || repeat('x', 2044) || 'paywall'")).otherwise(F.expr("'%PDF' || repeat('x', 2037) || 'Paywall'"))
    is_pdf, free = A.valid_payload(content)
    return table(spark, sf_dir, "pages").select("page_id", is_pdf.alias("is_pdf"), free.alias("no_paywall"))


_PAPER_IDS = """p AS (SELECT doc_id AS paper, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id END AS pmcid, 'PMID:' || doc_id AS pmid,
        CASE doc_id % 7 WHEN 0 THEN '10.1/arxiv.' || doc_id WHEN 1 THEN '10.1/x' || doc_id WHEN 2 THEN '10.48550/arXiv.' || doc_id || '/v2' WHEN 3 THEN '10.1371/journal.PLOS/' || doc_id WHEN 4 THEN '10.1038/nature/s' || doc_id WHEN 5 THEN '10.9/arxiv.' || doc_id || '/second/slash' END AS doi,
        CASE WHEN doc_id % 3 = 0 THEN 'On ArXiv ' || doc_id ELSE 'untitled' END AS title FROM documents)"""


@query(f"""
    WITH {_PAPER_IDS}, u AS (SELECT *, unnest(['EuropePMC', 'PMC OA', 'Direct PMC', 'Enhanced DOI', 'DOI', 'arXiv', 'arXiv API', 'PyPaperBot', 'Semantic Scholar', 'Unpaywall']) AS strategy FROM p)
    SELECT paper, strategy, CASE strategy
        WHEN 'EuropePMC' THEN 'https://europepmc.example/articles/PMC' || paper || '?pdf=render' WHEN 'PMC OA' THEN 'pmc-oa:PMC' || paper WHEN 'Direct PMC' THEN 'https://pmc.example/articles/PMC' || paper || '/pdf/'
        WHEN 'Enhanced DOI' THEN CASE paper % 7 WHEN 3 THEN 'https://plos.example/article/file?id=' || doi || '&type=printable' WHEN 4 THEN 'https://nature.example/articles/s' || paper || '.pdf' ELSE 'https://doi.example/' || doi END
        WHEN 'DOI' THEN 'https://doi.example/' || doi
        WHEN 'arXiv' THEN CASE paper % 7 WHEN 0 THEN 'https://arxiv.example/pdf/arxiv.' || paper || '.pdf' WHEN 2 THEN 'https://arxiv.example/pdf/v2.pdf' WHEN 5 THEN 'https://arxiv.example/pdf/slash.pdf' END
        WHEN 'arXiv API' THEN CASE paper % 7 WHEN 0 THEN 'arxiv:' || paper WHEN 2 THEN 'arxiv:10.48550' WHEN 5 THEN 'arxiv:' || paper ELSE 'arxiv-search:' || title END
        WHEN 'PyPaperBot' THEN coalesce('bot-doi:' || doi, 'bot-title:' || title) WHEN 'Semantic Scholar' THEN coalesce('scholar:DOI:' || doi, 'scholar:PMID:' || paper) ELSE 'unpaywall:' || doi END AS candidate
    FROM u WHERE CASE WHEN strategy IN ('EuropePMC', 'PMC OA', 'Direct PMC') THEN pmcid IS NOT NULL WHEN strategy IN ('Enhanced DOI', 'DOI', 'Unpaywall') THEN doi IS NOT NULL WHEN strategy LIKE 'arXiv%' THEN paper % 7 IN (0, 2, 5) OR paper % 3 = 0 ELSE true END
""")
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy that applies to a paper would ask for: DOIs of publishers, with a second slash, of arXiv in both cases, and papers that only their title gives away."""
    n, k = F.col("doc_id"), F.pmod("doc_id", F.lit(7))
    doi = (
        F.when(k == 0, F.concat(F.lit("10.1/arxiv."), _num())).when(k == 1, F.concat(F.lit("10.1/x"), _num())).when(k == 2, F.concat(F.lit("10.48550/arXiv."), _num(), F.lit("/v2"))).when(k == 3, F.concat(F.lit("10.1371/journal.PLOS/"), _num()))
        .when(k == 4, F.concat(F.lit("10.1038/nature/s"), _num())).when(k == 5, F.concat(F.lit("10.9/arxiv."), _num(), F.lit("/second/slash")))
    )
    title = F.when(n % 3 == 0, F.concat(F.lit("On ArXiv "), _num())).otherwise("untitled")
    own = papers(spark, sf_dir).select(n.alias("paper"), F.when(n % 2 == 0, F.concat(F.lit("PMC"), _num())).alias("pmcid"), "pmid", doi.alias("doi"), title.alias("title"))
    return A.routes(own).select("paper", "strategy", "candidate")

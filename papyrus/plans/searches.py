"""Queries over archives, names, questions, graphs, sketches and files, each with the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators import answers, articles, communities, derived, entities, normality, scoring, sketches
from papyrus.operators import attempts as A
from papyrus.plans import records
from papyrus.plans.panels_sql import FACTS, PART_EDGES, _facts, _part_edges, _words
from papyrus.plans.records import CHUNKS, NORM, QUESTION_TYPE, _article_xml, _asked
from papyrus.session import shared_folder
from papyrus.sources import files
from papyrus.sources.views import attempts, papers, scores, table
from papyrus.streaming import timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""
    WITH p AS (SELECT doc_id AS n, text, split_part(text, chr(10), 1) AS title, source FROM documents),
    a AS (SELECT n, title, source, trim(CASE n % 8
            WHEN 0 THEN {NORM.format("text")} || ' B: second part' WHEN 1 THEN 'A: ' || {NORM.format("text || ' nested end'")}
            WHEN 2 THEN {NORM.format("text")} WHEN 3 THEN '[Translated] ' || {NORM.format("text")} || ' [Other] other'
            WHEN 4 THEN trim(repeat('word ', 12)) WHEN 5 THEN '1234567890123456789' ELSE '12345678901234567890' END) AS a FROM p)
    SELECT CAST(n AS VARCHAR) AS pmid, CASE WHEN length(a) >= 20 THEN md5(a) END AS md5, source AS journal, CASE WHEN n % 2 = 0 THEN '10.1/' || n END AS doi, NULL AS error, NULL AS malformed FROM a
    UNION ALL SELECT 'x' || n, NULL, NULL, NULL, 'No article citation found', NULL FROM a WHERE n % 8 <> 7
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'Malformed article', '<PubmedArticle><PMID>x' || n || '</PMID></PubmedArticl' FROM a WHERE n % 8 = 7
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'Malformed article', '<PubmedArticle><PMID>' || n || '</PMID><b></PubmedArticle>' FROM a WHERE n % 5 = 0
""")
def article_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper's articles written to an archive of files and read back, cut at end tags: good articles, articles cut off before their end, and ones that are not well-formed."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n<PubmedArticle><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><b></PubmedArticle>"))).otherwise("")
    articles.write_archive(papers(spark, sf_dir).select(F.concat(F.regexp_replace(_article_xml(), "^<Set>|</Set>$", ""), bad).alias("xml")), path)
    cut_off = F.regexp_replace("malformed", "\n</PubmedArticle>$", "")  # where the end of a file cuts an article off it was closed there
    return articles.read_archive(spark, path).select("pmid", F.md5("abstract").alias("md5"), "journal", "doi", "error", cut_off.alias("malformed"))


NAMED = """named AS (SELECT doc_id, 'Made of ' || coalesce(p_name, 'nothing') || ' (' || coalesce(p_brand, '') || ') in ' || upper(n_name) || ', ' || lower(r_name) || '. ' || coalesce(text, '') AS text
        FROM documents LEFT JOIN part ON p_partkey = doc_id LEFT JOIN nation ON n_nationkey = doc_id % 25 LEFT JOIN region ON r_regionkey = doc_id % 5),
    g AS (SELECT DISTINCT 'product' AS kind, p_name AS name FROM part UNION SELECT DISTINCT 'brand', p_brand FROM part UNION SELECT DISTINCT 'nation', n_name FROM nation UNION SELECT DISTINCT 'region', r_name FROM region),
    hits AS (SELECT doc_id, kind, name, len(regexp_extract_all(lower(text), '\\b' || lower(name) || '\\b')) AS n FROM named, g WHERE contains(lower(text), lower(name)))"""


def _named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document behind a sentence that names a part, its brand, a nation and a region."""
    n = F.col("doc_id")
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    own = papers(spark, sf_dir).join(part, n == F.col("p_partkey"), "left").join(F.broadcast(nation), F.pmod(n, F.lit(25)) == F.col("n_nationkey"), "left").join(F.broadcast(region), F.pmod(n, F.lit(5)) == F.col("r_regionkey"), "left")  # 25 and 5 rows
    sentence = F.concat(F.lit("Made of "), F.coalesce("p_name", F.lit("nothing")), F.lit(" ("), F.coalesce("p_brand", F.lit("")), F.lit(") in "), F.upper("n_name"), F.lit(", "), F.lower("r_name"), F.lit(". "))
    return own.select("doc_id", F.concat(sentence, F.coalesce("abstract", F.lit(""))).alias("text"))


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kinds = [(part, "product", "p_name"), (part, "brand", "p_brand"), (table(spark, sf_dir, "nation"), "nation", "n_name"), (table(spark, sf_dir, "region"), "region", "r_name")]
    found = [t.select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct() for t, kind, c in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"WITH {NAMED} SELECT doc_id, kind, name, n FROM hits WHERE n > 0")
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name of the tables stands in each text, by one pass over the whole texts."""
    found = entities.entities(_named_texts(spark, sf_dir), _gazetteer(spark, sf_dir))
    return found.groupBy("doc_id", "kind", "name").agg(F.count("*").alias("n"))


@query(f"""
    WITH {NAMED}, c AS (SELECT kind, name, CAST(sum(n) AS BIGINT) AS n FROM hits WHERE n > 0 GROUP BY 1, 2), t AS (SELECT kind, CAST(sum(n) AS BIGINT) AS kind_total FROM c GROUP BY 1)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS rank, name, n, kind_total, (SELECT count(*) FROM t) AS kinds, (SELECT CAST(sum(kind_total) AS BIGINT) FROM t) AS total FROM c JOIN t USING (kind) QUALIFY rank <= 10
""")
def text_entity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent names of each kind in the texts, with totals."""
    return entities.entity_counts(entities.entities(_named_texts(spark, sf_dir), _gazetteer(spark, sf_dir)))


@query(f"""
    WITH {CHUNKS}, long AS (SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) > 100),
    x AS (SELECT doc_id, 'abstract' AS kind, chunk_id AS place, text FROM c WHERE chunk_id = 0 UNION ALL SELECT doc_id, 'fulltext', chunk_id, text FROM c WHERE doc_id IN (SELECT doc_id FROM long)
        UNION ALL SELECT doc_id, 'section', place - 1, s FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS s, generate_subscripts(str_split(text, chr(10)), 1) AS place FROM documents) WHERE length(trim(s)) > 100),
    qs AS (SELECT conv_id * 1000 + turn AS id, text || ' ' || ['how', 'results', 'trends', 'gaps', 'next', 'thematic', '', 'why', 'show methods'][CAST(conv_id % 9 AS INTEGER) + 1] AS question FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
    ty AS (SELECT id, question, lower(question) AS q FROM qs), k AS (SELECT id, question, {QUESTION_TYPE} AS type FROM ty),
    tg AS (SELECT id, question, type, CASE type WHEN 'methodological' THEN ['section', 'fulltext', 'abstract'] WHEN 'findings' THEN ['abstract', 'section', 'fulltext'] ELSE ['abstract', 'fulltext', 'section'] END AS targets FROM k),
    xw AS (SELECT doc_id, kind, place, unnest({_words("text")}) AS w FROM x), qw AS (SELECT id, unnest({_words("question")}) AS w FROM qs),
    st AS (SELECT unnest(['the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'is', 'are', 'was', 'were', 'be', 'been', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'this', 'that', 'these', 'those', 'we', 'our', 'study', 'studies', 'research', 'method', 'methods', 'analysis', 'using', 'used']) AS w),
    xt AS (SELECT doc_id, kind, place, CAST('0x' || left(md5(w), 8) AS BIGINT) % 65536 AS b, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS tf FROM xw WHERE w NOT IN (FROM st) GROUP BY 1, 2, 3, 4 HAVING tf <> 0),
    qt AS (SELECT id, CAST('0x' || left(md5(w), 8) AS BIGINT) % 65536 AS b, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS tf FROM qw WHERE w NOT IN (FROM st) GROUP BY 1, 2 HAVING tf <> 0),
    idf AS (SELECT b, ln(((SELECT count(*) FROM x) + 1) / (count(*) + 1)) + 1 AS idf FROM xt GROUP BY 1),
    xn AS (SELECT doc_id, kind, place, b, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id, kind, place)) AS weight FROM xt JOIN idf USING (b)),
    qi AS (SELECT id, b, tf * coalesce(idf, ln((SELECT count(*) FROM x) + 1) + 1) AS v FROM qt LEFT JOIN idf USING (b)), qn AS (SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS asked FROM qi),
    met AS (SELECT id, doc_id, kind, place, round(sum(asked * weight), 6) AS score FROM qn JOIN xn USING (b) GROUP BY 1, 2, 3, 4 HAVING score > 0),
    best AS (SELECT met.*, list_position(targets, kind) AS target, row_number() OVER (PARTITION BY id, kind ORDER BY score DESC, doc_id, place) AS n FROM met JOIN tg USING (id) QUALIFY n <= 2),
    one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id, doc_id ORDER BY target, n) = 1), found AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM one QUALIFY rank <= 7),
    sums AS (SELECT id, count(*) AS contexts, round(least(avg(score), 0.95), 6) AS confidence FROM found GROUP BY 1), used AS (SELECT id, rank, x.text FROM found JOIN x USING (doc_id, kind, place) WHERE rank <= 3),
    sp AS (SELECT id, rank, unnest(str_split(text, '.')) AS s, generate_subscripts(str_split(text, '.'), 1) AS pos FROM used), sn AS (SELECT id, rank, pos, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM sp),
    sh AS (SELECT id, rank, pos, s, len(list_intersect(list_distinct(str_split(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), ' ')), list_distinct(str_split(lower(s), ' ')))) AS shared FROM sn JOIN qs USING (id) WHERE length(s) > 20),
    said AS (SELECT id, string_agg(s, '. ' ORDER BY n) || '.' AS said FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY shared DESC, rank, pos) AS n FROM sh WHERE shared > 0 QUALIFY n <= 3) GROUP BY 1)
    SELECT tg.id AS question_id, type, coalesce(contexts, 0) AS contexts, coalesce(confidence, 0) AS confidence, coalesce(said, 'The nearest text begins: ' || left(used.text, 200), 'The texts at hand do not hold enough to answer this.') AS answer
    FROM tg LEFT JOIN sums USING (id) LEFT JOIN said USING (id) LEFT JOIN used ON used.id = tg.id AND used.rank = 1
""")
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of every twentieth conversation as questions, answered from the abstracts, chunks and sections of all papers."""
    asked = _asked(spark, sf_dir).where("conv_id % 20 = 0")  # the stated query set
    return answers.answers(asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "question"), answers.contexts_of(papers(spark, sf_dir)))


@query(None)
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that are ordered together, in communities by modularity."""
    return communities.communities(_part_edges(spark, sf_dir))[0]


@query(f"""
    WITH RECURSIVE {PART_EDGES}, v AS (SELECT DISTINCT src AS node FROM b), r(a, z, d) AS (SELECT node, node, 0 FROM v UNION SELECT r.a, b.dst, r.d + 1 FROM r JOIN b ON b.src = r.z WHERE r.d < 30),
    h AS (SELECT a, z, min(d) AS d FROM r GROUP BY 1, 2), p(a, z, d) AS (SELECT node, node, 0 FROM v UNION ALL SELECT p.a, b.dst, p.d + 1 FROM p JOIN b ON b.src = p.z JOIN h ON h.a = p.a AND h.z = b.dst AND h.d = p.d + 1),
    s AS (SELECT a, z, d, count(*) AS paths FROM p GROUP BY 1, 2, 3), c_all AS (SELECT count(*) AS k FROM v),
    t AS (SELECT x.z AS node, sum(x.paths * y.paths / w.paths) AS dep FROM s x JOIN s y ON x.z = y.a JOIN s w ON w.a = x.a AND w.z = y.z AND w.d = x.d + y.d WHERE x.a <> x.z AND y.a <> y.z GROUP BY 1),
    c AS (SELECT a AS node, (count(*) - 1) * (count(*) - 1) / nullif(sum(d), 0) AS near FROM s GROUP BY 1)
    SELECT node, round(coalesce(dep, 0) / greatest(1, (k - 1) * (k - 2)), 6) AS betweenness, round(near / greatest(1, k - 1), 6) AS closeness FROM v LEFT JOIN t USING (node) JOIN c USING (node), c_all
""")
def graph_centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness and closeness of the parts that are ordered together, all of them as sources."""
    found = communities.centralities(_part_edges(spark, sf_dir))
    return found.select("node", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events), f AS (SELECT DISTINCT day AS first FROM d)
    SELECT first, first + CAST(k AS INTEGER) AS last, count(*) AS n, count(DISTINCT user_id) AS exact, true AS near FROM f, (SELECT unnest([0, 6, 29]) AS k) t JOIN d ON d.day BETWEEN first AND first + CAST(k AS INTEGER) GROUP BY 1, 2
""")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users over 1, 7 and 30 days from every day on, from one sketch a day and exactly. The days before and from the middle on are added to the state apart.

    near: the estimate lies within five standard errors of the exact number (or within 2 of it).
    """
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("item"))
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    middle = days.agg(F.date_add(F.min("day"), F.floor(F.datediff(F.max("day"), F.min("day")) / 2).cast("int")).alias("m")).first()["m"]  # one row
    sketches.add_days(days.where(F.col("day") < F.lit(middle)), path)
    sketches.add_days(days.where(F.col("day") >= F.lit(middle)), path)
    ranges = days.select(F.col("day").alias("first")).distinct().withColumn("k", F.explode(F.array(*map(F.lit, (0, 6, 29))))).select("first", F.date_add("first", F.col("k")).alias("last"))
    exact = days.distinct().join(F.broadcast(ranges), F.col("day").between(F.col("first"), F.col("last"))).groupBy("first", "last").agg(F.count_distinct("item").alias("exact"))  # three rows a day
    found = sketches.distinct_over(spark, path, ranges).join(exact, ["first", "last"])
    off = F.abs(F.col("distinct") - F.col("exact"))
    return found.select("first", "last", "n", "exact", (off <= F.greatest(F.lit(2.0), 5 * 0.83 / 2 ** (sketches.LG_K / 2) * F.col("exact"))).alias("near"))


@query(None)
def normality_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the prices of all lines from the normal law."""
    found = normality.normality(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select("n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("d", 9).alias("d"), F.round("p", 9).alias("p"))


@query("""
    WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a' || page_id || '.pdf' WHEN 1 THEN 'sub.pdf/b' || page_id || '.PDF' WHEN 2 THEN 'c' || page_id || '.txt' WHEN 3 THEN 'd' || page_id || '.Pdf' ELSE 'e.pdf/e' || page_id || '.html' END AS path,
        CASE page_id % 5 WHEN 3 THEN '' ELSE CASE WHEN page_id % 2 = 0 THEN '%PDF-1.4 ' ELSE '' END || coalesce(html, '') END AS content FROM pages)
    SELECT split_part(path, '/', -1) AS name, strlen(content) AS length, strlen(content) >= 1024 AND starts_with(content, '%PDF') AS is_pdf, NOT regexp_matches(lower(left(content, 2048)), '<html|<!doctype|access denied|subscription required|paywall') AS no_paywall FROM f WHERE page_id % 5 IN (0, 1, 3)
""")
def pdf_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file, some of them empty, some in folders whose names end in .pdf; the .pdf files are listed and checked from their bytes."""
    n, num = F.col("page_id"), F.col("page_id").cast("string")
    k = F.pmod("page_id", F.lit(5))
    name = F.when(k == 0, F.concat(F.lit("a"), num, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("sub.pdf/b"), num, F.lit(".PDF"))).when(k == 2, F.concat(F.lit("c"), num, F.lit(".txt"))).when(k == 3, F.concat(F.lit("d"), num, F.lit(".Pdf"))).otherwise(F.concat(F.lit("e.pdf/e"), num, F.lit(".html")))
    content = F.when(k == 3, "").otherwise(F.concat(F.when(n % 2 == 0, F.lit("%PDF-1.4 ")).otherwise(""), F.coalesce("html", F.lit(""))))
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    files.write_files(table(spark, sf_dir, "pages").select(name.alias("name"), content.alias("content")), folder).agg(F.count("*")).first()  # one row
    return files.pdf_files(spark, folder).select("name", "length", "is_pdf", "no_paywall")


@query(records.ORACLES["breaker_states"])
def stream_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker's states by timers over the attempts as a stream."""
    found = timers.run(timers.breaker(timers.attempts_stream(spark, sf_dir))).where("event_id IS NOT NULL")
    return found.groupBy("strategy", "state").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.sum("event_id").alias("events"))


@query(records.ORACLES["token_bucket"])
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets' answers over the attempts as a stream."""
    found = timers.run(timers.bucket(timers.attempts_stream(spark, sf_dir)))
    return found.groupBy("strategy", (F.col("state") == "granted").alias("granted")).agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


USED = "used AS (SELECT d.doc_id, lang AS analysis_type, ['local', 'remote', 'none'][CAST(d.doc_id % 3 AS INTEGER) + 1] AS backend, n_chars / 1000.0::DOUBLE AS seconds, CAST(n_chars AS BIGINT) AS milli, quality, toxic FROM labels l JOIN documents d USING (doc_id))"
USE = "SELECT what, name, count(*) AS n, (20000 * CAST(sum(milli) AS BIGINT) + 1000 * count(*)) // (2000 * count(*)) / 10000.0 AS mean_seconds, CAST(sum(milli) AS BIGINT) / 1000 AS total_seconds, min(seconds) AS fastest, max(seconds) AS slowest FROM (SELECT 'all' AS what, '' AS name, * FROM used UNION ALL SELECT 'type', analysis_type, * FROM used UNION ALL SELECT 'backend', backend, * FROM used) GROUP BY 1, 2"


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored papers with one of three backends."""
    return scores(spark, sf_dir).withColumn("backend", F.get(F.array(*map(F.lit, ("local", "remote", "none"))), F.pmod("paper_id", F.lit(3)).cast("int")))


@query(f"WITH {USED} {USE}")
def analysis_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and times of the analyses over all, by type and by backend."""
    return scoring.usage(_used(spark, sf_dir))


@query(f"""
    WITH {USED}, u AS ({USE}), x AS (SELECT unnest(['overall_quality', 'clarity', 'innovation']) AS name, unnest([CAST(quality * 4 + doc_id % 7 AS DOUBLE), CAST(10 - toxic * 5 - doc_id % 5 AS DOUBLE), (doc_id % 11) * 0.9::DOUBLE]) AS score FROM used)
    SELECT 'statistics' AS part, what, name, n, mean_seconds AS mean FROM u UNION ALL SELECT 'statistics', 'score', name, count(*), round(avg(score), 4) FROM x GROUP BY name
    UNION ALL SELECT 'results', 'score', name, count(*), round(avg(score), 4) FROM x GROUP BY name
""")
def export_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results and their statistics as JSON files, read back: counts and means from the statistics beside those of the exported results."""
    own = _used(spark, sf_dir)
    rows, facts = scoring.export_with_statistics(own, own, f"{shared_folder(spark)}/results")
    again = rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean")).select(F.lit("results").alias("part"), F.lit("score").alias("what"), "name", "n", "mean")
    return facts.select(F.lit("statistics").alias("part"), "what", "name", "n", "mean").unionByName(again)


STATE = f"""{FACTS}, p AS (SELECT topics, (least(availability, 100) + least(coherence * 100, 100) + least(topics * 10.0, 100) + least((1 - abs(polarity)) * 100, 100) + 100) / 5 AS quality FROM facts),
    a AS (SELECT count(*) FILTER (ok) / count(*) AS share FROM (SELECT bool_or(value >= 10) AS ok FROM events GROUP BY user_id)), state AS (SELECT round(quality, 4) AS quality, topics, share, true AS rated FROM p, a)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the overall quality, the number of topics, the share of papers with a successful attempt, and that there is a sentiment."""
    facts = _facts(spark, sf_dir)
    overall = derived.quality_components(facts).where("component = 'overall'").select(F.col("value").alias("quality"))
    share = A.batch_result(attempts(spark, sf_dir)).select((F.col("ok") / F.col("papers")).alias("share"))
    return overall.join(F.broadcast(facts.select("topics"))).join(F.broadcast(share)).withColumn("rated", F.lit(True))  # one row each


@query(f"""
    WITH {STATE}, m AS (SELECT unnest(['methodology', 'theory', 'evidence', 'statistics', 'reproducibility']) AS metric, unnest([round(least(quality / 100, 1), 4), round(least(topics / 10, 1), 4), round(share, 4), 1.0, CASE WHEN quality > 70 THEN 0.8 WHEN quality > 40 THEN 0.5 ELSE 0.3 END]) AS value FROM state)
    SELECT metric, value, CASE WHEN value >= 0.8 THEN 'mature' WHEN value >= 0.5 THEN 'developing' ELSE 'emerging' END AS level FROM m
""")
def maturity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.maturity(_state(spark, sf_dir))


@query(f"""
    WITH {STATE}, r AS (SELECT list_filter([CASE WHEN quality < 50 THEN 'collect data in a better way' END, CASE WHEN topics < 3 THEN 'cover more topics' END, CASE WHEN share < 0.5 THEN 'make the data easier to get' END,
        CASE WHEN quality >= 75 THEN 'publish' WHEN quality >= 50 THEN 'refine the methods' ELSE 'design the work anew' END, CASE WHEN quality >= 75 THEN 'look for partners' WHEN quality >= 50 THEN 'take a larger sample' END], lambda x: x IS NOT NULL)[1:6] AS l FROM state)
    SELECT CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS place, unnest(l) AS text FROM r
""")
def corpus_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.recommendations(_state(spark, sf_dir))

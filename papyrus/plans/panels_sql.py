"""Queries over panels, models and graphs, each with the DuckDB SQL that gives the same rows (models have none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrus.functions import text as T
from papyrus.functions.stats import ratio
from papyrus.operators import corpus, derived, frequency, graph, ingest, learning, panels, prompts, retrieval, scoring, sentiment, similarity, topics, trends
from papyrus.plans.records import ASKED, QUESTION_TYPE, _asked
from papyrus.sources.views import papers, scores, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _words(col: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}'))"


STOPS = "(" + ", ".join(f"'{w}'" for w in T.ABSTRACT_STOPS) + ")"
#: Journals as topics with their ten most frequent terms; weight is a term's share of the ten.
TOPICS = f"""tw AS (SELECT source AS topic, w AS word, count(*) AS n FROM (SELECT source, unnest({_words("text")}) AS w FROM documents) WHERE w NOT IN {STOPS} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) <= 10),
    topics AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank, word, round(n / sum(n) OVER (PARTITION BY topic), 6) AS weight FROM tw),
    quality AS (SELECT topic, round(avg(weight) FILTER (rank <= 5), 4) AS coherence FROM topics GROUP BY 1)"""
LEXICON = "lex(w, p) AS (VALUES " + ", ".join(
    f"('{w}', {p})" for w, p in {
        "good": 0.7, "excellent": 1.0, "effective": 0.6, "successful": 0.75, "promising": 0.5, "best": 1.0, "better": 0.5, "new": 0.1, "great": 0.8, "significant": 0.4,
        "poor": -0.4, "failed": -0.5, "limited": -0.1, "difficult": -0.5, "challenging": -0.3, "bad": -0.7, "worthless": -0.9, "trash": -0.8, "disgusting": -1.0, "scum": -0.9,
    }.items()
) + ")"
RATED = f"""{LEXICON}, lw AS (SELECT doc_id, unnest({_words("text")}) AS w FROM documents), lr AS (SELECT doc_id, avg(p) AS p FROM lw JOIN lex USING (w) GROUP BY 1),
    rated AS (SELECT doc_id, source AS topic, round(coalesce(p, 0), 6) AS polarity, CASE WHEN coalesce(round(p, 6), 0) > 0.1 THEN 'positive' WHEN coalesce(round(p, 6), 0) < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM documents LEFT JOIN lr USING (doc_id))"""
ENTITIES = "entities AS (SELECT p_type AS kind, p_brand AS name FROM part)"
PHASES = "phases AS (SELECT lang AS phase, n_chars / 1000.0 AS seconds FROM documents)"
EMOTIVE = ["good results of an excellent method", "poor and limited", "found and described", "a successful approach. The outcome was good. Future work is difficult", "no words"]


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = frequency.top_terms_by_journal(papers(spark, sf_dir))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("journal"))
    return best.select(F.col("journal").alias("topic"), "rank", F.col("term").alias("word"), F.round(share, 6).alias("weight"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.sentiment(papers(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("name"))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages as phases, whose documents take a second for each thousand characters."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("phase"), (F.col("n_chars") / 1000.0).alias("seconds"))


def _emotive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with one of five sentences in front, so that the word lists find something."""
    more = F.get(F.array(*map(F.lit, EMOTIVE)), (F.col("doc_id") % len(EMOTIVE)).cast("int"))
    return papers(spark, sf_dir).withColumn("abstract", F.concat(more, F.lit(". "), F.coalesce("abstract", F.lit(""))))


EMOTIVE_SQL = "em AS (SELECT doc_id, [" + ", ".join(f"'{t}'" for t in EMOTIVE) + "][CAST(doc_id % 5 AS INTEGER) + 1] || '. ' || coalesce(text, '') AS text FROM documents)"


FACTS = f"""{TOPICS}, {RATED}, facts AS (SELECT (SELECT round(avg(CAST(text IS NOT NULL AS INTEGER)) * 100, 6) FROM documents) AS availability, (SELECT count(DISTINCT lang) FROM documents) AS kinds, (SELECT count(DISTINCT word) FROM tw) AS words,
    (SELECT round(avg(polarity), 6) FROM rated) AS polarity, (SELECT count(*) FROM quality) AS topics, (SELECT round(avg(c), 6) FROM (SELECT sum(n) FILTER (rank <= 5) / sum(n) AS c FROM tw JOIN topics USING (topic, word) GROUP BY topic)) AS coherence)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.corpus_facts(papers(spark, sf_dir), _rated(spark, sf_dir), frequency.top_terms_by_journal(papers(spark, sf_dir)))


@query(f"""
    WITH {FACTS}, p AS (SELECT *, least(availability, 100) AS a, least(coherence * 100, 100) AS c, least(topics * 10.0, 100) AS t, least((1 - abs(polarity)) * 100, 100) AS b, least(kinds * 20.0, 100) AS e FROM facts)
    SELECT unnest(['availability', 'coherence', 'topics', 'balance', 'phases', 'overall', 'c_availability', 'c_topics', 'c_sentiment', 'c_entities', 'c_clusters', 'completeness', 'i_words', 'i_entities', 'i_topics', 'i_balance']) AS component,
        unnest(list_transform([CAST(a AS DOUBLE), c, t, b, 100, (a + c + t + b + 100) / 5, a, t, 100, e, 50, (a + t + 100 + e + 50) / 5, least(words / 100.0, 1), least(kinds / 10.0, 1), CASE WHEN topics > 3 THEN 1 WHEN topics > 1 THEN 0.5 ELSE 0 END, 1 - abs(polarity)], lambda x: round(x, 4))) AS value FROM p
""")
def quality_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.quality_components(_facts(spark, sf_dir))


@query(f"WITH {FACTS}, h AS (SELECT CAST(least(topics * 80.0 / 100, 40) AS DOUBLE) AS high FROM facts), m AS (SELECT high, least((100 - high) * 0.4, 35) AS medium FROM h), l AS (SELECT *, least((100 - high - medium) * 0.6, 20) AS low FROM m) SELECT high, medium, low, 100 - high - medium - low AS niche FROM l")
def citation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.citation_split(_facts(spark, sf_dir), 80.0)


@query("""
    WITH a AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, turn - 1 AS turn, text AS context FROM conversations WHERE role <> 'user'),
    p AS (SELECT conv_id * 1000 + turn AS id, list_distinct(str_split(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), ' ')) AS asked, context FROM a JOIN c USING (conv_id, turn)),
    s AS (SELECT id, asked, pos, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM (SELECT id, asked, unnest(str_split(context, '.')) AS s, generate_subscripts(str_split(context, '.'), 1) AS pos FROM p)),
    o AS (SELECT id, pos, s, len(list_intersect(asked, list_distinct(str_split(lower(s), ' ')))) AS k FROM s WHERE length(s) > 20), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, pos) AS rn FROM o WHERE k > 0 QUALIFY rn <= 3),
    j AS (SELECT id, string_agg(s, '. ' ORDER BY rn) AS answer, CAST(sum(k) AS BIGINT) AS overlap FROM b GROUP BY 1)
    SELECT id, coalesce(answer, left(context, 200)) AS answer, coalesce(overlap, 0) AS overlap FROM p LEFT JOIN j USING (id)
""")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the next turn of its conversation as context."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    context = c.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return retrieval.extractive_answers(asked.join(context, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "context"))


@query(f"WITH {PHASES}, s AS (SELECT phase, sum(seconds) AS s FROM phases GROUP BY 1) SELECT count(*) AS phases, round(sum(s), 4) AS total, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std FROM s")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.phase_times(_phases(spark, sf_dir))


@query(f"WITH {TOPICS} SELECT count(*) AS topics, round(avg(coherence), 6) AS mu, round(stddev_pop(coherence), 6) AS sigma, round(median(coherence), 6) AS median FROM quality")
def normal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.normal_fit(_topics(spark, sf_dir))


@query(f"""
    WITH {TOPICS}, {RATED}, {PHASES}, s AS (SELECT phase, sum(seconds) AS s FROM phases GROUP BY 1)
    SELECT 'papers' AS metric, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS std FROM documents UNION ALL SELECT 'abstract_percent', round(avg(CAST(text IS NOT NULL AS INTEGER)) * 100, 4), 0 FROM documents
    UNION ALL SELECT 'coherence', round(avg(coherence), 4), round(stddev_pop(coherence), 4) FROM quality UNION ALL SELECT 'polarity', round(avg(polarity), 4), round(stddev_pop(polarity), 4) FROM rated
    UNION ALL SELECT 'seconds', round(sum(s), 4), round(stddev_pop(s), 4) FROM s UNION ALL SELECT 'phase_percent', round(avg(CAST(s > 0 AS INTEGER)) * 100, 4), 0 FROM s
""")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.summary_table(papers(spark, sf_dir), _rated(spark, sf_dir), _topics(spark, sf_dir), _phases(spark, sf_dir))


@query("SELECT count(*) AS files, count(*) FILTER (strlen(html) > 3000) AS converted, round(avg(CAST(strlen(html) > 3000 AS INTEGER)), 6) AS rate FROM pages")
def conversion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.conversion_rate(table(spark, sf_dir, "pages"), F.octet_length("html") > 3000)


@query(f"WITH {ENTITIES} SELECT kind, count(*) AS total, count(DISTINCT name) AS names, least(count(DISTINCT name), 10) AS shown FROM entities GROUP BY 1")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.entity_totals(_entities(spark, sf_dir))


@query(f"""
    WITH {TOPICS}, {ENTITIES}, k AS (SELECT kind, count(*) AS n, row_number() OVER (ORDER BY kind) - 1 AS place FROM entities GROUP BY 1), q AS (SELECT coherence, row_number() OVER (ORDER BY topic) - 1 AS place, count(*) OVER () AS m FROM quality)
    SELECT kind, n, coherence FROM k JOIN q ON k.place % m = q.place
""")
def entity_coherence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.entity_coherence_pairs(_entities(spark, sf_dir), _topics(spark, sf_dir))


@query(f"WITH {TOPICS} SELECT topic, word, round(weight * 100, 4) AS strength FROM topics WHERE topic IN (SELECT topic FROM quality ORDER BY topic LIMIT 4)")
def topic_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.topic_strengths(_topics(spark, sf_dir))


@query(f"""
    WITH {RATED} SELECT 'topics' AS measure, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'entities', count(DISTINCT p_type) FROM part UNION ALL SELECT 'clusters', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'sentiments', count(DISTINCT label) FROM rated
""")
def complexity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.complexity(_topics(spark, sf_dir), _entities(spark, sf_dir), table(spark, sf_dir, "embeddings"), _rated(spark, sf_dir))


@query(f"""
    WITH {TOPICS}, {RATED}, {ENTITIES} SELECT 'coherence' AS part, topic AS name, coherence AS value FROM quality UNION ALL SELECT 'polarity', 'mean', round(avg(polarity), 6) FROM rated
    UNION ALL SELECT 'cluster', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label UNION ALL SELECT 'entity', kind, least(count(DISTINCT name), 10) FROM entities GROUP BY kind
""")
def nlp_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.nlp_panel(_topics(spark, sf_dir), _rated(spark, sf_dir), table(spark, sf_dir, "embeddings"), _entities(spark, sf_dir))


@query(f"""
    WITH {ASKED}, t AS (SELECT {QUESTION_TYPE} AS type FROM asked) SELECT 'index' AS part, 'abstract' AS name, count(*) FILTER (length(trim(coalesce(text, ''))) > 50) AS n FROM documents UNION ALL SELECT 'index', 'fulltext', count(*) FILTER (length(trim(coalesce(text, ''))) > 100) FROM documents
    UNION ALL SELECT 'index', 'section', count(*) FROM (SELECT unnest(str_split(text, chr(10))) AS s FROM documents) WHERE length(trim(s)) > 100 UNION ALL SELECT 'type', type, count(*) FROM t GROUP BY type UNION ALL SELECT 'success', lang, count(*) FILTER (toxic = 0) FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def rag_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), ["doc_id"]).select(F.col("lang").alias("category"), F.when(F.col("toxic") != 0, "toxic").alias("error"))
    return panels.rag_panel(retrieval.eligible_counts(papers(spark, sf_dir)), retrieval.classify(_asked(spark, sf_dir)), answers)


@query(
    f"WITH {RATED}, {PHASES}, i(category, question) AS (VALUES " + ", ".join(f"('{c}', '{q}')" for c, q in prompts.INSIGHTS.items()) + """)
    SELECT 'phase' AS part, phase AS name, printf('%.2f', round(sum(seconds), 2)) AS value FROM phases GROUP BY phase UNION ALL SELECT 'count', 'papers', CAST(count(*) AS VARCHAR) FROM documents UNION ALL SELECT 'count', 'abstracts', CAST(count(text) AS VARCHAR) FROM documents
    UNION ALL SELECT 'count', 'journals', CAST(count(DISTINCT source) AS VARCHAR) FROM documents UNION ALL SELECT 'sentiment', label, printf('%.2f', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rated)) FROM rated GROUP BY label
    UNION ALL (SELECT 'insight', category, question FROM i ORDER BY category LIMIT 5)"""
)
def one_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.one_page(_phases(spark, sf_dir), papers(spark, sf_dir), _rated(spark, sf_dir), prompts.insight_questions(spark))


@query(f"""
    WITH {TOPICS}, {RATED}, d AS (SELECT CAST(1995 + doc_id % 7 AS INTEGER) AS year, coherence AS weight, polarity FROM rated JOIN quality USING (topic)),
    y AS (SELECT year, count(*) AS n, round(avg(weight), 4) AS strength, round(stddev_pop(weight), 4) AS band, round(avg(polarity), 6) AS polarity FROM d GROUP BY 1), l AS (SELECT regr_slope(n, year) AS a, regr_intercept(n, year) AS b FROM y)
    SELECT year, n, strength, band, polarity, round(a * year + b, 4) AS fitted FROM y, l
""")
def yearly_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers, dated by their number, with their journal's coherence as strength."""
    rated = papers(spark, sf_dir).select("doc_id", F.col("journal").alias("topic")).join(_rated(spark, sf_dir), ["doc_id"]).join(topics.topic_quality(_topics(spark, sf_dir)), ["topic"])
    return panels.yearly_strength(rated.select((1995 + F.col("doc_id") % 7).cast("int").alias("year"), F.col("coherence").alias("weight"), "polarity"))


@query("""
    WITH sc AS (SELECT d.doc_id AS paper_id, CAST(quality * 4 + d.doc_id % 7 AS DOUBLE) AS q, CAST(10 - toxic * 5 - d.doc_id % 5 AS DOUBLE) AS c, CAST((d.doc_id % 11) * 0.9 AS DOUBLE) AS i FROM labels l JOIN documents d USING (doc_id)),
    ex AS (SELECT paper_id, 'overall_quality' AS name, q AS score FROM sc UNION ALL SELECT paper_id, 'clarity', c FROM sc UNION ALL SELECT paper_id, 'innovation', i FROM sc)
    SELECT name, count(*) AS n, min(score) AS low, max(score) AS high, count(DISTINCT paper_id) AS papers FROM ex GROUP BY 1
""")
def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranges(scores(spark, sf_dir))


@query(f"WITH {EMOTIVE_SQL}, e(emotion, word) AS (VALUES ('positive', 'good'), ('positive', 'excellent'), ('positive', 'effective'), ('positive', 'successful'), ('positive', 'promising'), ('negative', 'poor'), ('negative', 'failed'), ('negative', 'limited'), ('negative', 'difficult'), ('negative', 'challenging'), ('neutral', 'shown'), ('neutral', 'observed'), ('neutral', 'found'), ('neutral', 'reported'), ('neutral', 'described')) SELECT emotion, word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM em) JOIN e USING (word) GROUP BY 1, 2")
def emotion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.emotion_counts(_emotive(spark, sf_dir))


@query(f"WITH {EMOTIVE_SQL}, h AS (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ("method", "methodology", "approach", "technique", "algorithm")) + " AS k FROM em) SELECT sum(k) AS hits, count(*) AS texts, round(sum(k) / count(*), 6) AS share, sum(k) / count(*) < 0.3 AS gap FROM h")
def gap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.method_gap(_emotive(spark, sf_dir))


@query(f"""
    WITH {EMOTIVE_SQL}, {LEXICON}, a(aspect, pattern) AS (VALUES ('method', 'method|approach|technique|procedure'), ('result', 'result|finding|outcome|effect'), ('conclusion', 'conclusion|summary|implication'), ('limitation', 'limitation|constraint|drawback'), ('future work', 'future|next|further|upcoming')),
    s AS (SELECT doc_id, aspect, list_filter(str_split(text, '.'), lambda x: regexp_matches(lower(x), pattern)) AS s FROM em, a), f AS (SELECT doc_id, aspect, len(s) AS k, array_to_string(s, '.') AS t FROM s WHERE len(s) > 0),
    w AS (SELECT doc_id, aspect, unnest({_words('t')}) AS w FROM f), p AS (SELECT doc_id, aspect, avg(p) AS p FROM w JOIN lex USING (w) GROUP BY 1, 2)
    SELECT aspect, count(*) AS n_texts, CAST(sum(k) AS BIGINT) AS n_sentences, round(avg(coalesce(p, 0)), 6) AS mean FROM f LEFT JOIN p USING (doc_id, aspect) GROUP BY 1
""")
def aspect_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.aspects(_emotive(spark, sf_dir))


@query(f"""
    WITH {RATED}, o AS (SELECT count(*) AS n, round(avg(polarity), 6) AS mean, round(stddev_pop(polarity), 6) AS std, avg(CAST(label = 'positive' AS INTEGER)) AS p, avg(CAST(label = 'negative' AS INTEGER)) AS m, avg(CAST(label = 'neutral' AS INTEGER)) AS z FROM rated),
    h AS (SELECT *, -(p * log2(p + 1e-10) + m * log2(m + 1e-10) + z * log2(z + 1e-10)) AS h FROM o)
    SELECT n, mean, std, round(p, 6) AS positive, round(m, 6) AS negative, round(z, 6) AS neutral, round(1.96 * sqrt(p * (1 - p) / n) * 100, 6) AS half_width, round(h, 6) AS entropy, round(1 - h / log2(3), 6) AS stability FROM h
""")
def sentiment_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.overall(_rated(spark, sf_dir))


@query("""
    WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM u), s AS (SELECT q.vec_id AS query_id, v.label AS kind, v.vec_id AS id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3), f AS (SELECT query_id, id // 2 AS paper_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id // 2 ORDER BY kind, rank) = 1),
    c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) <= 5)
    SELECT query_id, round(least(avg(score), 0.95), 6) AS confidence, count(DISTINCT paper_id) AS sources FROM c GROUP BY 1
""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # the stated query set
    found = similarity.nearest(asked, e.select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("v")), k=3)
    return retrieval.confidence(retrieval.dedupe_contexts(found.select("query_id", F.floor(F.col("id") / 2).alias("paper_id"), F.col("kind").alias("target_rank"), "rank", "score")))


@query("""
    WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM f GROUP BY 1, 2), v AS (SELECT label, list(m ORDER BY d) AS m FROM m GROUP BY 1)
    SELECT a.label AS a, b.label AS b, round(list_inner_product(a.m, b.m) / (sqrt(list_inner_product(a.m, a.m)) * sqrt(list_inner_product(b.m, b.m))), 6) AS cosine FROM v a JOIN v b ON a.label < b.label
""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.label_similarity(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v")))


_VOWELS = "[aeiouyàâäáéèêëíîïóôöúûüùœæ]+"


@query(f"""
    WITH c AS (SELECT source, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT source, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}'']+')) AS n, len(regexp_extract_all(t, '{_VOWELS}')) AS s, greatest(len(regexp_extract_all(t, '[.!?]+')), 1) AS p FROM c)
    SELECT source AS journal, count(*) AS n, round(avg(CASE WHEN n > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * n / p - 84.6::DOUBLE * greatest(s, n) / n END), 4) AS flesch_syllabic FROM k GROUP BY 1
""")
def flesch_by_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flesch_by_journal(papers(spark, sf_dir))


def _replaced(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '" + pattern.replace("'", "''") + "', '" + to.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '") + "', 'g')"
    return column


_MARKDOWN = _replaced("coalesce(html, '')", ingest.MARKDOWN)


@query(f"SELECT page_id, length(m) AS n_chars, md5(m) AS md5 FROM (SELECT page_id, trim({_MARKDOWN}, ' ') AS m FROM pages) WHERE strlen(m) > 100")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.markdown(table(spark, sf_dir, "pages")).select("page_id", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


@query("""
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, label, max(s / n) FILTER (other = label) AS a, min(s / n) FILTER (other <> label) AS b FROM d GROUP BY 1, 2)
    SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m GROUP BY 1
""")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of each label over the distances between all vectors."""
    return topics.silhouettes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))


@query(f"WITH {LEXICON}, w AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents), s AS (SELECT doc_id, avg(abs(p)) AS s FROM w JOIN lex USING (w) GROUP BY 1) SELECT source AS journal, count(*) AS n, round(avg(coalesce(s, 0)), 6) AS mean, round(stddev_pop(coalesce(s, 0)), 6) AS std FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1")
def subjectivity_by_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = papers(spark, sf_dir).select("journal", sentiment.subjectivity(F.col("abstract")).alias("s"))
    return own.groupBy("journal").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("std"))


@query(f"WITH {TOPICS} SELECT topic, word, CAST(floor(weight * 100) AS BIGINT) AS size FROM topics")
def topic_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).select("topic", "word", F.floor(F.col("weight") * 100).alias("size"))


@query("""
    WITH y AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '1989' WHEN 2 THEN '1990' WHEN 3 THEN NULL ELSE CAST(1990 + doc_id % 30 AS VARCHAR) END AS year FROM documents)
    SELECT CAST(year AS INTEGER) AS year, count(*) AS n FROM y WHERE TRY_CAST(year AS INTEGER) >= 1990 GROUP BY 1
""")
def numeric_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as strings; those that are no number, missing or before 1990 drop out."""
    n = F.col("doc_id")
    year = F.when(n % 6 == 0, "n/a").when(n % 6 == 1, "1989").when(n % 6 == 2, "1990").when(n % 6 == 3, F.lit(None)).otherwise((1990 + n % 30).cast("string"))
    return trends.yearly_counts(papers(spark, sf_dir).select(year.alias("year")).select(F.col("year").try_cast("int").alias("year")).where("year is not null"))


_TYPES = ["overall_quality", "methodology", "innovation", "field_impact", "comparative", "insight"]


@query(
    "WITH t(kind, model, tokens) AS (VALUES ('overall_quality', 'small', 500), ('methodology', 'small', 500), ('innovation', 'small', 500), ('field_impact', 'small', 500), ('comparative', 'large', 800), ('insight', 'large', 500)), "
    "d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN length(trim(text)) >= 100 THEN text ELSE split_part(text, chr(10), 1) END AS u FROM documents), p AS (SELECT doc_id, length('Title: ' || title || chr(10) || 'Text: ' || CASE WHEN length(u) > 3000 THEN left(u, 3000) || '... [truncated]' ELSE u END) AS n FROM d) "
    "SELECT kind, model, tokens, count(*) AS requests, CAST(sum(n) AS BIGINT) AS n_chars FROM p, t GROUP BY 1, 2, 3"
)
def analysis_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper's prompt for each of six analysis types: requests and characters that each model gets."""
    asked = retrieval.analysis_prompts(papers(spark, sf_dir)).select("n_chars", F.explode(F.array(*map(F.lit, _TYPES))).alias("kind"))
    model, tokens = prompts.model_settings(F.col("kind"))
    return asked.groupBy("kind", model.alias("model"), tokens.alias("tokens")).agg(F.count("*").alias("requests"), F.sum("n_chars").alias("n_chars"))


@query(f"""
    WITH s AS (SELECT doc_id, list_sort(list_distinct({_words('text', 4)})) AS t FROM documents), c AS (SELECT min(doc_id) AS id, t FROM s WHERE len(t) > 0 GROUP BY t), x AS (SELECT id, len(t) AS n, unnest(t) AS w FROM c),
    p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL), j AS (SELECT a, b, (2000000 * k + na + nb - k) // (2 * (na + nb - k)) / 1000000.0 AS jaccard FROM p WHERE k / (na + nb - k) > 0.05), m AS (SELECT a AS row, jaccard FROM j UNION ALL SELECT b, jaccard FROM j)
    SELECT row, count(*) AS neighbours, CAST(sum(CAST(jaccard AS DECIMAL(10, 6))) AS DOUBLE) AS total, max(jaccard) AS most FROM m GROUP BY 1
""")
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the similarity matrix (both halves) each row's entries, their sum and the largest."""
    pairs = similarity.jaccard_pairs(similarity.term_sets(papers(spark, sf_dir)), 0.05).select("a", "b", ratio(F.col("shared"), F.col("total"), 6).alias("jaccard"))
    return similarity.mirrored(pairs).groupBy("row").agg(F.count("*").alias("neighbours"), F.sum(F.col("jaccard").cast("decimal(10,6)")).cast("double").alias("total"), F.max("jaccard").alias("most"))


#: Nations whose suppliers deliver for the same order.
@query("""
    WITH RECURSIVE n AS (SELECT DISTINCT l_suppkey AS node, l_orderkey AS o FROM lineitem), e AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM n a JOIN n b ON a.o = b.o AND a.node < b.node),
    b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), v AS (SELECT DISTINCT src AS node FROM b), r(a, z, d) AS (SELECT node, node, 0 FROM v UNION SELECT r.a, b.dst, r.d + 1 FROM r JOIN b ON b.src = r.z WHERE r.d < 6),
    h AS (SELECT a, z, min(d) AS d FROM r GROUP BY 1, 2), c AS (SELECT a, min(z) AS c FROM h GROUP BY 1), k AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1), t AS (SELECT x.src AS node, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN b q ON q.src = x.dst AND q.dst = y.dst GROUP BY 1)
    SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT c) FROM c) AS components, (SELECT count(DISTINCT c) = 1 FROM c) AS connected, CASE WHEN (SELECT count(DISTINCT c) = 1 FROM c) THEN (SELECT max(d) FROM h) END AS diameter,
        (SELECT round(avg(coalesce(round(2.0 * t / nullif(degree * (degree - 1), 0), 6), 0)), 6) FROM k LEFT JOIN t USING (node)) AS clustering
""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, components, connectivity, diameter (null where there are several components) and average clustering of the suppliers that deliver for the same orders."""
    return graph.metrics(graph.shared_item_edges(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey"))


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together, both of a size under 6: a sparse graph of a good many components."""
    small = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size < 6"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.shared_item_edges(small, "l_partkey", "l_orderkey")


PART_EDGES = "n AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS o FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 6), e AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM n a JOIN n b ON a.o = b.o AND a.node < b.node GROUP BY 1, 2), b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


@query(f"""
    WITH RECURSIVE {PART_EDGES}, v AS (SELECT DISTINCT src AS node FROM b), r(a, z, d) AS (SELECT node, node, 0 FROM v UNION SELECT r.a, b.dst, r.d + 1 FROM r JOIN b ON b.src = r.z WHERE r.d < 30),
    h AS (SELECT a, z, min(d) AS d FROM r GROUP BY 1, 2), c AS (SELECT a AS node, min(z) AS component, max(d) AS e FROM h GROUP BY 1)
    SELECT component, count(*) AS nodes, max(e) AS diameter FROM c GROUP BY 1
""")
def component_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component of the parts' graph with its number of nodes and its diameter."""
    return graph.diameters(_part_edges(spark, sf_dir))


@query(None)
def lda_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.lda_perplexity(papers(spark, sf_dir))

"""DuckDB SQL, written from the definitions, that gives the rows of the catalogue's queries."""

from __future__ import annotations

from papyrus.functions import text as T
from papyrus.operators import attempts, retrieval, sentiment


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _words(col: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}'))"


def _wc(col: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), '\\S+'))"


PAPERS = "papers AS (SELECT doc_id, 'PMID:' || doc_id AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract, source AS journal, lang AS keyword FROM documents)"
DATED = "dated AS (SELECT o_orderkey AS pmid, o_orderdate AS pub_date, o_orderpriority AS journal, year(o_orderdate) AS year FROM orders)"
ATTEMPTS = "att AS (SELECT event_id, event_type AS strategy, user_id AS paper, ts, value, value >= 10 AS success, CAST(ts AS DATE) AS day FROM events)"
SCORES = """sc AS (SELECT d.doc_id AS paper_id, source AS journal, lang AS analysis_type, n_chars / 1000.0 AS seconds,
  CAST(quality * 4 + d.doc_id % 7 AS DOUBLE) AS q, CAST(10 - toxic * 5 - d.doc_id % 5 AS DOUBLE) AS c, CAST((d.doc_id % 11) * 0.9 AS DOUBLE) AS i FROM labels l JOIN documents d USING (doc_id)),
ex AS (SELECT paper_id, journal, analysis_type, seconds, 'overall_quality' AS name, q AS score FROM sc UNION ALL SELECT paper_id, journal, analysis_type, seconds, 'clarity', c FROM sc UNION ALL SELECT paper_id, journal, analysis_type, seconds, 'innovation', i FROM sc)"""
HAS = "length(trim(regexp_replace(abstract, '\\s+', ' ', 'g'))) > 0"
READ = f"CASE WHEN {_wc('abstract')} = 0 OR len(list_filter(str_split(coalesce(abstract, ''), '.'), lambda s: length(trim(regexp_replace(s, '\\s+', ' ', 'g'))) > 0)) = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, 206.835 - 1.015 * {_wc('abstract')} / len(list_filter(str_split(coalesce(abstract, ''), '.'), lambda s: length(trim(regexp_replace(s, '\\s+', ' ', 'g'))) > 0)))) END"
NORM = "trim(lower(regexp_replace(regexp_replace(abstract, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
LEX = "lex(w, p) AS (VALUES " + ", ".join(f"('{w}', {p:.2f}::DOUBLE)" for w, p in sentiment.LEXICON.items()) + ")"
QTYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in retrieval.QUESTION_TYPES) + " ELSE 'general' END"
IDMAP = "idmap AS (SELECT CAST(doc_id AS VARCHAR) AS clean_pmid, CASE WHEN quality = 1 THEN 'PMC' || doc_id END AS pmcid FROM labels)"
EDGES = "e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= {least})"
ENDS = "ends AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
W = "WITH "

TOPICS = f"{PAPERS}, tt AS (SELECT journal AS topic, w AS word, count(*) AS n, row_number() OVER (PARTITION BY journal ORDER BY count(*) DESC, w) AS rank FROM (SELECT journal, unnest({_words('abstract')}) AS w FROM papers) WHERE w NOT IN {_in(T.ABSTRACT_STOPS)} GROUP BY 1, 2 QUALIFY rank <= 10), topics AS (SELECT topic, word, rank, round(n / sum(n) OVER (PARTITION BY topic), 6) AS weight FROM tt)"
ENTITIES = f"entities AS (SELECT 'The ' || w AS entity FROM (SELECT unnest({_words('title')}) AS w FROM papers) WHERE w NOT IN {_in(T.TITLE_STOPS)} GROUP BY w ORDER BY count(*) DESC, w LIMIT 12)"

ORACLES: dict[str, str] = {
    "topic_word_pairs": f"{W}{TOPICS}, f AS (SELECT topic, word FROM topics WHERE rank <= 5), b AS (SELECT word FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) SELECT x.word AS a, y.word AS b, count(*) AS n FROM f x JOIN f y ON x.topic = y.topic AND x.word < y.word WHERE x.word IN (FROM b) AND y.word IN (FROM b) GROUP BY 1, 2 HAVING count(*) > 1",
    "topic_entity_links": f"{W}{TOPICS}, {ENTITIES} SELECT topic, entity, count(*) AS weight FROM topics JOIN entities ON contains(lower(entity), word) GROUP BY 1, 2",
    "topic_entity_positions": f"{W}{TOPICS}, {ENTITIES}, t AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS i FROM (SELECT DISTINCT topic FROM topics)), e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS i FROM entities) SELECT topic, entity FROM t JOIN e ON e.i // 2 = t.i",
    "topic_word_stats": f"{W}{TOPICS} SELECT word, count(*) AS n, round(avg(weight), 4) AS mean, round(stddev_samp(weight), 4) AS std FROM topics GROUP BY 1 ORDER BY mean DESC, word LIMIT 10",
    "topic_quality": f"{W}{TOPICS} SELECT topic, round(avg(weight) FILTER (rank <= 5), 4) AS coherence, round(count(DISTINCT word) / 10, 4) AS variety, round(avg(weight), 4) AS mean, round(stddev_pop(weight), 4) AS std FROM topics GROUP BY 1",
    "weakest_topics": f"{W}{TOPICS} SELECT topic, round(avg(weight) FILTER (rank <= 5), 4) AS coherence FROM topics GROUP BY 1 ORDER BY 2, 1 LIMIT 3",
    "word_length_bins": f"{W}{TOPICS} SELECT length(word) AS length, CAST(least(floor(weight * 10 / (SELECT max(weight) FROM topics)), 9) AS INTEGER) AS bin, count(*) AS n FROM topics GROUP BY 1, 2",
    "coherence_sentiment": f"{W}{TOPICS}, {LEX}, c AS (SELECT topic, avg(weight) AS c FROM topics WHERE rank <= 5 GROUP BY 1), r AS (SELECT doc_id, avg(p) AS p FROM (SELECT doc_id, unnest({_words('text')}) AS w FROM documents) JOIN lex USING (w) GROUP BY 1), p AS (SELECT source AS topic, avg(round(coalesce(p, 0), 6)) AS p FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1) SELECT count(*) AS topics, round(covar_pop(c, p) / nullif(var_pop(p), 0), 4) AS slope, round(covar_pop(c, p) / nullif(stddev_pop(c) * stddev_pop(p), 0), 4) AS r FROM c JOIN p USING (topic)",
    "corpus_overview": f"{W}{PAPERS}, o AS (SELECT count(*) AS papers, count(*) FILTER ({HAS}) AS with_abstract, count(*) FILTER (length(abstract) >= 100) AS long, count(DISTINCT journal) AS journals, count(DISTINCT keyword) AS languages, count(*) FILTER (contains(abstract, '.')) AS with_sentences FROM papers) SELECT measure, value FROM o UNPIVOT (value FOR measure IN (papers, with_abstract, long, journals, languages, with_sentences))",
    "score_density": f"{W}{SCORES}, k AS (SELECT round((0.25 * q + 0.10 * c + 0.20 * i) / 0.55, 6) AS x FROM sc), h AS (SELECT stddev_samp(x) * pow(count(x), -0.2) AS h, count(x) AS n FROM k), g AS (SELECT 10.0::DOUBLE * i / 20 AS place FROM range(21) t(i)) SELECT place, round(sum(exp(-pow((place - x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM k, h, g GROUP BY place",
    "abstract_recovery": "WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(trim(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '') WHEN 1 THEN replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' b' END AS a FROM documents) SELECT doc_id, length(a) AS n_chars, md5(a) AS md5 FROM a",
    "dbscan_components": "WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.id, b.id AS other, round(list_distance(a.e, b.e), 9) AS d FROM v a JOIN v b ON a.id <> b.id), p AS (SELECT quantile_cont(m, 0.95) AS eps FROM (SELECT min(d) AS m FROM d GROUP BY id)), l AS (SELECT id, other FROM d, p WHERE d <= eps), r(id, reached) AS (SELECT id, id FROM l UNION SELECT r.id, l.other FROM r JOIN l ON l.id = r.reached) SELECT v.id, coalesce(c, -1) AS cluster FROM v LEFT JOIN (SELECT id, min(reached) AS c FROM r GROUP BY 1) USING (id)",
    "generated_questions": "SELECT question_id, question FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(retrieval.FIXED_QUESTIONS)) + ") v(question_id, question) UNION ALL SELECT 5, 'How do these papers treat ' || string_agg(lang, ', ' ORDER BY n DESC, lang) || '?' FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL SELECT 6, 'What changed between ' || min(year(o_orderdate)) || ' and ' || max(year(o_orderdate)) || '?' FROM orders",
    "corpus_context": f"{W}{PAPERS}, l AS (SELECT doc_id, (CASE WHEN length(title) > 50 THEN left(title, 50) || '...' ELSE title END) || ': ' || (CASE WHEN length(abstract) > 200 THEN left(abstract, 200) || '...' ELSE abstract END) AS line FROM papers ORDER BY doc_id LIMIT 20), c AS (SELECT string_agg(line, chr(10) ORDER BY doc_id) AS c FROM l) SELECT length(c) AS n_chars, md5(c) AS md5, (SELECT count(*) FROM documents) - 20 AS rest FROM c",
    "response_length_hist": "WITH x AS (SELECT CAST(length(text) AS DOUBLE) AS v FROM conversations WHERE role = 'assistant'), b AS (SELECT min(v) AS lo, max(v) AS hi, 20 AS bins FROM x), p AS (SELECT least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS bin, lo, (hi - lo) / bins AS width FROM x, b) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(first(lo + bin * width), 4) AS low FROM p GROUP BY bin",
    "search_limit": f"{W}{PAPERS} SELECT doc_id, pmid, CASE WHEN length(title) > 50 THEN left(title, 50) || '...' ELSE title END AS title FROM papers WHERE contains(lower(abstract), 'licensed') ORDER BY doc_id LIMIT 25 OFFSET 5",
    "batch_numbers": "SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents) GROUP BY batch",
    "coverage_stats": f"{W}{PAPERS} SELECT count(*) AS total, count(*) FILTER ({HAS}) AS with_abstract, count(*) FILTER (NOT coalesce({HAS}, false)) AS without_abstract, round(coalesce(count(*) FILTER ({HAS}) * 100.0 / nullif(count(*), 0), 0), 4) AS percent, round(coalesce(avg(length(abstract)) FILTER (length(abstract) > 0), 0), 4) AS mean_length FROM papers",
    "coverage_suggestions": f"{W}{PAPERS}, s AS (SELECT count(*) AS total, count(*) FILTER (NOT coalesce({HAS}, false)) AS missing, (SELECT count(*) FROM labels WHERE toxic = 1) AS errors, count(*) FILTER ({HAS}) * 100.0 / nullif(count(*), 0) AS percent FROM papers) SELECT 'recover ' || missing || ' abstracts' AS suggestion FROM s WHERE missing > 0 UNION ALL SELECT 'retry ' || errors || ' failed requests' FROM s WHERE errors > 0 UNION ALL SELECT 'ask for missing abstracts one by one' FROM s WHERE total > 0 AND percent < 98",
    "text_normalize": f"{W}{PAPERS} SELECT doc_id, length({NORM}) AS n_chars, md5({NORM}) AS md5, CASE WHEN length(title) > 30 THEN left(title, 30) || '...' ELSE title END AS label, CAST(doc_id AS VARCHAR) AS clean_pmid FROM papers",
    "readability": f"{W}{PAPERS} SELECT doc_id, round({READ}, 6) AS readability, {_wc('abstract')} AS n_words FROM papers",
    "word_count_hist": f"{W}{PAPERS}, x AS (SELECT CAST({_wc('abstract')} AS DOUBLE) AS v FROM papers), b AS (SELECT min(v) AS lo, max(v) AS hi, least(15, count(DISTINCT v)) AS bins FROM x), p AS (SELECT CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) ELSE 0 END AS bin, lo, (hi - lo) / bins AS width FROM x, b) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(first(lo + bin * width), 4) AS low FROM p GROUP BY bin",
    "sentence_lengths": "SELECT words, count(*) AS n FROM (SELECT len(regexp_extract_all(s, '\\S+')) AS words FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]+')) AS s FROM documents)) WHERE words > 3 GROUP BY words",
    "text_summary": f"{W}{PAPERS} SELECT count(*) AS papers, count(*) FILTER ({HAS}) AS with_abstracts, sum({_wc('abstract')}) AS total_words, round(avg({_wc('abstract')}) FILTER ({HAS}), 4) AS mean_words, round(avg({READ}) FILTER ({HAS}), 4) AS mean_readability, (SELECT count(DISTINCT w) FROM (SELECT unnest({_words('abstract')}) AS w FROM papers)) AS distinct_terms FROM papers",
    "top_terms": f"{W}{PAPERS} SELECT w AS term, count(*) AS n FROM (SELECT unnest({_words('abstract')}) AS w FROM papers) WHERE w NOT IN {_in(T.ABSTRACT_STOPS)} GROUP BY w ORDER BY n DESC, w LIMIT 15",
    "title_terms": f"{W}{PAPERS} SELECT w AS term, count(*) AS n FROM (SELECT unnest({_words('title')}) AS w FROM papers) WHERE w NOT IN {_in(T.TITLE_STOPS)} GROUP BY w ORDER BY n DESC, w LIMIT 12",
    "top_bigrams": f"{W}{PAPERS}, t AS (SELECT {_words('abstract', 4)} AS t FROM papers), p AS (SELECT unnest(list_zip(t[:-2], t[2:])) AS z FROM t WHERE len(t) > 1) SELECT z[1] || ' ' || z[2] AS term, count(*) AS n FROM p WHERE z[1] NOT IN {_in(T.BIGRAM_STOPS)} GROUP BY 1 ORDER BY n DESC, term LIMIT 10",
    "query_term_df": "SELECT term, (SELECT count(*) FROM documents WHERE contains(lower(coalesce(text, '')), term)) AS n_docs, round((SELECT count(*) FROM documents WHERE contains(lower(coalesce(text, '')), term)) * 100.0 / (SELECT count(*) FROM documents), 4) AS percent FROM (VALUES ('tion'), ('license'), ('theory'), ('token')) v(term)",
    "term_cooccurrence": f"{W}{PAPERS}, d AS (SELECT doc_id, unnest({_words('abstract', 4)}) AS w FROM papers), top AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM d WHERE w NOT IN {_in(T.COOCCURRENCE_STOPS)} GROUP BY w QUALIFY r <= 8), s AS (SELECT DISTINCT doc_id, w, r FROM d JOIN top USING (w)) SELECT x.w AS a, y.w AS b, count(*) AS n FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.r < y.r GROUP BY 1, 2",
    "top_terms_by_journal": f"{W}{PAPERS}, t AS (SELECT journal, w AS term, count(*) AS n FROM (SELECT journal, unnest({_words('abstract')}) AS w FROM papers) WHERE w NOT IN {_in(T.ABSTRACT_STOPS)} GROUP BY 1, 2), j AS (SELECT journal, count(*) AS papers, round(avg(length(abstract)), 4) AS mean_length FROM papers GROUP BY 1) SELECT journal, CAST(rank AS INTEGER) AS rank, term, n, papers, mean_length FROM (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY n DESC, term) AS rank FROM t) JOIN j USING (journal) WHERE rank <= 10",
    "cloud_weights": f"{W}{PAPERS}, t AS (SELECT w AS term, count(*) AS n FROM (SELECT unnest({_words('abstract', 4)}) AS w FROM papers) WHERE w NOT IN {_in(T.CLOUD_STOPS)} GROUP BY w ORDER BY n DESC, w LIMIT 30) SELECT term, n, CAST(floor(n * 100 / (SELECT max(n) FROM t)) AS BIGINT) AS weight FROM t",
    "tfidf": f"{W}{PAPERS}, o AS (SELECT doc_id, list_filter({_words('abstract', 2)}, lambda x: x NOT IN {_in(T.ABSTRACT_STOPS)}) AS o FROM papers), u AS (SELECT doc_id, unnest(o) AS w FROM o UNION ALL SELECT doc_id, unnest(list_transform(list_zip(o[:-2], o[2:]), lambda z: z[1] || ' ' || z[2])) FROM o WHERE len(o) > 1), tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM u GROUP BY 1, 2), n AS (SELECT count(*) AS docs FROM papers), k AS (SELECT term, ln((1 + docs) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM tf, n GROUP BY term, docs HAVING count(*) >= 2 AND count(*) <= 0.8 * docs ORDER BY total DESC, term LIMIT 1000), w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN k USING (term)), x AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w) SELECT doc_id, term, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM x QUALIFY rank <= 5",
    "yearly_counts": f"{W}{DATED} SELECT CAST(year AS INTEGER) AS year, count(*) AS n FROM dated WHERE year >= 1990 GROUP BY year",
    "trend_slope_peak": f"{W}{DATED}, y AS (SELECT year, count(*) AS n FROM dated WHERE year >= 1990 GROUP BY year) SELECT round(regr_slope(n, year), 6) AS slope, (SELECT CAST(year AS INTEGER) FROM y ORDER BY n DESC, year LIMIT 1) AS peak_year, max(n) AS peak_n, count(*) AS years FROM y",
    "journal_trends": f"{W}{DATED}, b AS (SELECT journal, count(*) AS total FROM dated GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), c AS (SELECT journal, year, count(*) AS n FROM dated GROUP BY 1, 2) SELECT journal, total, CASE WHEN count(*) > 1 THEN round(regr_slope(n, year), 6) END AS slope, arg_max(n, year) AS recent FROM c JOIN b USING (journal) GROUP BY 1, 2",
    "keyword_evolution": "WITH r AS (SELECT year(l_shipdate) AS year, unnest(str_split(p_name, ' ')) AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT year, keyword, count(*) AS n FROM r GROUP BY 1, 2) SELECT CAST(year AS INTEGER) AS year, keyword, n, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, keyword) AS INTEGER) AS rank FROM c QUALIFY rank <= 10",
    "common_keywords": "SELECT keyword, count(*) AS n FROM (SELECT unnest(str_split(p_name, ' ')) AS keyword FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "journal_year_matrix": f"{W}{DATED}, b AS (SELECT journal, count(*) AS total FROM dated GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT journal, " + ", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in range(1995, 2002)) + " FROM dated JOIN b USING (journal) GROUP BY 1",
    "dataset_summary": f"{W}{DATED} SELECT (SELECT journal FROM dated GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_journal, count(DISTINCT journal) AS journals, (SELECT CAST(year AS INTEGER) FROM dated GROUP BY year ORDER BY count(*) DESC, year LIMIT 1) AS top_year, count(*) AS total, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year FROM dated",
    "top_journals": f"{W}{PAPERS} SELECT journal, count(*) AS n FROM papers WHERE trim(journal) <> '' AND journal <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "years_in_text": "SELECT CAST(y AS INTEGER) AS year, count(*) AS n FROM (SELECT regexp_extract(text, '20\\d{2}', 0) AS y FROM documents) WHERE y <> '' GROUP BY 1",
    "id_enrichment": f"{W}{PAPERS}, {IDMAP} SELECT CAST(doc_id AS VARCHAR) AS clean_pmid, pmcid, pmcid IS NOT NULL AS has_fulltext FROM papers LEFT JOIN (SELECT clean_pmid, min(pmcid) AS pmcid FROM idmap WHERE pmcid IS NOT NULL GROUP BY 1) ON clean_pmid = CAST(doc_id AS VARCHAR)",
    "cache_probe": f"{W}{IDMAP} SELECT state, count(*) AS n FROM (SELECT CASE WHEN clean_pmid IS NULL THEN 'miss' WHEN pmcid IS NULL THEN 'negative' ELSE 'hit' END AS state FROM documents LEFT JOIN idmap ON clean_pmid = CAST(doc_id AS VARCHAR)) GROUP BY 1",
    "pending_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "recovery_cascade": "SELECT CAST(doc_id AS VARCHAR) AS clean_pmid, CASE WHEN quality IS NULL THEN text WHEN quality = 1 THEN 'quality ' || doc_id WHEN toxic = 1 THEN 'toxic ' || doc_id END AS abstract, CASE WHEN quality IS NULL THEN 'own' WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS origin FROM documents LEFT JOIN labels USING (doc_id)",
    "id_fallback": "SELECT CAST(d.doc_id AS VARCHAR) AS clean_pmid, CASE WHEN d.doc_id % 3 = 0 THEN 'PMC' || d.doc_id WHEN quality = 1 THEN 'PMC1' || d.doc_id WHEN toxic = 1 THEN 'PMC2' || d.doc_id END AS pmcid, CASE WHEN d.doc_id % 3 = 0 THEN 'own' WHEN quality = 1 THEN 'link' WHEN toxic = 1 THEN 'cross' ELSE 'none' END AS origin FROM documents d LEFT JOIN labels USING (doc_id)",
    "json_idconv": "SELECT CAST(doc_id AS VARCHAR) AS pmid, 'PMC' || doc_id AS pmcid FROM labels WHERE quality = 1",
    "json_links": "SELECT doc_id, CAST(doc_id * 10 AS VARCHAR) AS link FROM documents",
    "jaccard_pairs": f"{W}s AS (SELECT doc_id, list_sort(list_distinct({_words('text', 4)})) AS t FROM documents), c AS (SELECT min(doc_id) AS id, t FROM s WHERE len(t) > 0 GROUP BY t), x AS (SELECT id, len(t) AS n, unnest(t) AS w FROM c), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) > 0.05 * greatest(a.n, b.n) GROUP BY ALL) SELECT a, b, (2000000 * k + na + nb - k) // (2 * (na + nb - k)) / 1000000.0 AS jaccard FROM p WHERE k / (na + nb - k) > 0.05",
    "jaccard_classes": f"{W}s AS (SELECT doc_id, list_sort(list_distinct({_words('text', 4)})) AS t FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS rep FROM s WHERE len(t) > 0",
    "group_term_jaccard": f"{W}{PAPERS}, t AS (SELECT journal, w, row_number() OVER (PARTITION BY journal ORDER BY count(*) DESC, w) AS r FROM (SELECT journal, unnest({_words('abstract')}) AS w FROM papers) WHERE w NOT IN {_in(T.ABSTRACT_STOPS)} GROUP BY 1, 2 QUALIFY r <= 10), n AS (SELECT journal, count(*) AS n FROM t GROUP BY 1) SELECT x.journal AS a, y.journal AS b, round(count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)), 6) AS jaccard FROM t x JOIN t y ON x.w = y.w AND x.journal < y.journal JOIN n nx ON nx.journal = x.journal JOIN n ny ON ny.journal = y.journal GROUP BY 1, 2",
    "vector_topk": "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM u), s AS (SELECT q.vec_id AS query_id, v.label AS kind, v.vec_id AS id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0) SELECT query_id, CAST(kind AS INTEGER) AS kind, id, score, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3",
    "retrieve_dedupe": "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM u), s AS (SELECT q.vec_id AS query_id, v.label AS kind, v.vec_id AS id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3), f AS (SELECT query_id, id // 2 AS paper_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id // 2 ORDER BY kind, rank) = 1) SELECT query_id, paper_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS INTEGER) AS place FROM f QUALIFY place <= 5",
    "index_sizes": "SELECT 'abstract' AS kind, count(*) FILTER (length(trim(coalesce(text, ''))) > 50) AS n FROM documents UNION ALL SELECT 'fulltext', count(*) FILTER (length(trim(coalesce(text, ''))) > 100) FROM documents UNION ALL SELECT 'section', count(*) FROM (SELECT unnest(str_split(text, chr(10))) AS s FROM documents) WHERE length(trim(s)) > 100",
    "analysis_prompts": "WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN length(trim(text)) >= 100 THEN text ELSE split_part(text, chr(10), 1) END AS u FROM documents), p AS (SELECT doc_id, length(u) > 3000 AS truncated, 'Title: ' || title || chr(10) || 'Text: ' || CASE WHEN length(u) > 3000 THEN left(u, 3000) || '... [truncated]' ELSE u END AS p FROM d) SELECT doc_id, length(p) AS n_chars, truncated, md5(p) AS md5 FROM p",
    "score_extract": "SELECT doc_id, CAST(doc_id % 7 AS DOUBLE) AS quality, CAST(quality * 4 + 0.5 AS DOUBLE) AS overall, 2 AS n FROM labels",
    "fallback_scores": "SELECT score, count(*) AS n FROM (SELECT round(CASE WHEN doc_id % 4 = 0 THEN doc_id % 10 WHEN doc_id % 4 = 1 THEN (doc_id % 9) + 0.5 ELSE 5.0 END, 4) AS score FROM labels) GROUP BY 1",
    "score_batch_summary": f"{W}{SCORES} SELECT analysis_type, name, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS low, max(score) AS high, round(median(score), 4) AS median, round(avg(seconds), 4) AS mean_seconds, count(DISTINCT paper_id) AS papers FROM ex GROUP BY 1, 2",
    "score_stats": f"{W}{SCORES} SELECT 'score' AS what, name, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std FROM ex GROUP BY 2 UNION ALL SELECT 'seconds', analysis_type, count(*), round(avg(seconds), 4), round(stddev_pop(seconds), 4) FROM sc GROUP BY 2",
    "top_by_score": f"{W}{SCORES} SELECT paper_id, round(i, 6) AS score FROM sc ORDER BY 2 DESC, 1 LIMIT 20",
    "composite_rank": f"{W}{SCORES} SELECT paper_id, journal, round((0.25 * q + 0.10 * c + 0.20 * i) / 0.55, 6) AS composite FROM sc",
    "journal_boxplot": f"{W}{SCORES}, k AS (SELECT left(journal, 20) AS journal, round((0.25 * q + 0.10 * c + 0.20 * i) / 0.55, 6) AS x FROM sc) SELECT journal, count(*) AS n, min(x) AS low, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS q2, round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS high FROM k GROUP BY 1 HAVING count(*) >= 2",
    "response_stats": "SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_length, round(avg(turn), 4) AS mean_turn, CASE WHEN count(*) > 2 THEN round(covar_pop(length(text), turn) / nullif(stddev_pop(length(text)) * stddev_pop(turn), 0), 4) END AS corr FROM conversations GROUP BY 1",
    "strategy_routing": "WITH s(strategy, priority, position, needs) AS (VALUES ('EuropePMC', 0, 0, 'pmcid'), ('PMC OA', 1, 1, 'pmcid'), ('Direct PMC', 2, 2, 'pmcid'), ('Enhanced DOI', 3, 3, 'doi'), ('DOI', 3, 4, 'doi'), ('arXiv', 4, 5, 'arxiv'), ('arXiv API', 5, 6, 'arxiv'), ('PyPaperBot', 7, 7, 'title or doi'), ('Semantic Scholar', 8, 8, 'any'), ('Unpaywall', 10, 9, 'doi')), p AS (SELECT d.doc_id AS paper, CASE WHEN quality = 1 THEN 'PMC' || d.doc_id END AS pmcid, CASE WHEN d.doc_id % 3 = 0 THEN '10.1/arxiv.' || d.doc_id WHEN d.doc_id % 3 = 1 THEN '10.1/x' || d.doc_id END AS doi FROM documents d LEFT JOIN labels USING (doc_id)) SELECT strategy, CAST(place AS INTEGER) AS place, count(*) AS n FROM (SELECT paper, strategy, row_number() OVER (PARTITION BY paper ORDER BY priority, position) AS place FROM p, s WHERE CASE needs WHEN 'pmcid' THEN pmcid IS NOT NULL WHEN 'doi' THEN doi IS NOT NULL WHEN 'arxiv' THEN contains(coalesce(doi, ''), 'arxiv') ELSE true END) GROUP BY 1, 2",
    "first_success": f"{W}{ATTEMPTS} SELECT paper, strategy, event_id FROM att WHERE success QUALIFY row_number() OVER (PARTITION BY paper ORDER BY list_position(['click', 'view', 'purchase', 'signup', 'error'], strategy), ts, event_id) = 1",
    "batch_result": f"{W}{ATTEMPTS}, b AS (SELECT paper, bool_or(success) AS ok FROM att GROUP BY 1) SELECT count(*) AS papers, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(avg(CAST(ok AS INTEGER)), 6) AS rate FROM b",
    "strategy_stats": f"{W}{ATTEMPTS} SELECT coalesce(strategy, 'ALL') AS strategy, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(avg(CAST(success AS INTEGER)), 6) AS rate FROM att GROUP BY GROUPING SETS ((strategy), ())",
    "retry_fold": f"{W}{ATTEMPTS}, t AS (SELECT *, row_number() OVER (PARTITION BY paper, strategy ORDER BY ts, event_id) AS try FROM att QUALIFY try <= 3) SELECT paper, strategy, CAST(max(try) AS INTEGER) AS tries, bool_or(success) AS ok, arg_max(event_id, try) AS last_event, CAST(sum(CASE WHEN try > 1 THEN pow(2, try - 2) ELSE 0 END) AS DOUBLE) AS waited FROM t GROUP BY 1, 2",
    "lexicon_sentiment": f"{W}{LEX}, t AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents), r AS (SELECT doc_id, avg(p) AS p FROM t JOIN lex USING (w) GROUP BY 1) SELECT doc_id, round(coalesce(p, 0.0), 6) AS polarity, CASE WHEN coalesce(round(p, 6), 0) > 0.1 THEN 'positive' WHEN coalesce(round(p, 6), 0) < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM documents LEFT JOIN r USING (doc_id)",
    "phase_trend": f"{W}{DATED}, y AS (SELECT year, count(*) AS n FROM dated GROUP BY 1), s AS (SELECT regr_slope(n, year) / avg(n) AS r FROM y) SELECT round(r, 6) AS relative_slope, CASE WHEN r > 0.01 THEN 'Improving' WHEN r < -0.01 THEN 'Declining' ELSE 'Stable' END AS label FROM s",
    "graph_density": f"{W}{EDGES.format(least=1)}, {ENDS} SELECT (SELECT count(DISTINCT node) FROM ends) AS nodes, count(*) AS edges, sum(weight) AS weight, round(2.0 * count(*) / ((SELECT count(DISTINCT node) FROM ends) * ((SELECT count(DISTINCT node) FROM ends) - 1)), 6) AS density FROM e",
    "degree_centrality": f"{W}{EDGES.format(least=1)}, {ENDS} SELECT node, count(*) AS degree, sum(weight) AS strength, round(count(*) / ((SELECT count(DISTINCT node) FROM ends) - 1), 6) AS centrality FROM ends GROUP BY node ORDER BY degree DESC, node LIMIT 10",
    "clustering_coeff": f"{W}{EDGES.format(least=1)}, {ENDS}, d AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1), t AS (SELECT x.node, count(*) AS triangles FROM ends x JOIN ends y ON x.node = y.node AND x.other < y.other JOIN e ON e.src = x.other AND e.dst = y.other GROUP BY 1) SELECT node, degree, coalesce(triangles, 0) AS triangles, round(coalesce(2.0 * triangles / nullif(degree * (degree - 1), 0), 0), 6) AS coefficient FROM d LEFT JOIN t USING (node)",
    "modularity_q": f"{W}{EDGES.format(least=1)}, {ENDS}, g AS (SELECT s_suppkey AS node, s_nationkey AS grp FROM supplier), m AS (SELECT sum(weight) AS m FROM e), i AS (SELECT a.grp, sum(CASE WHEN a.grp = b.grp THEN weight ELSE 0 END) AS inside FROM e JOIN g a ON a.node = src JOIN g b ON b.node = dst GROUP BY 1), s AS (SELECT grp, sum(weight) AS s FROM ends JOIN g USING (node) GROUP BY 1) SELECT round(sum(coalesce(inside, 0) / m - pow(s / (2 * m), 2)), 6) AS q, count(*) AS groups FROM s LEFT JOIN i USING (grp), m",
    "components": f"{W}RECURSIVE {EDGES.format(least=1)}, {ENDS}, r(node, reached) AS (SELECT node, node FROM ends UNION SELECT r.node, ends.other FROM r JOIN ends ON ends.node = r.reached) SELECT node, min(reached) AS component FROM r GROUP BY node",
    "adjacency": f"{W}{EDGES.format(least=1)}, {ENDS}, b AS (SELECT node FROM ends GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 20) SELECT node, count(*) AS n, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours FROM ends WHERE node IN (SELECT node FROM b) AND other IN (SELECT node FROM b) GROUP BY node",
    "top_entities": "WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand, n, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM n QUALIFY rank <= 3",
    "cluster_sizes": "WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS clusters, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, round(stddev_pop(n) / avg(n), 6) AS variation FROM s",
    "silhouette": "WITH f AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label AS other, d, avg(CAST(x AS DOUBLE)) AS m FROM f GROUP BY 1, 2), e AS (SELECT vec_id, label, other, sum(pow(x - m, 2)) AS d FROM f JOIN m USING (d) GROUP BY 1, 2, 3), s AS (SELECT vec_id, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM e GROUP BY 1) SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s",
    "dominant_component": "SELECT vec_id AS id, list_position(e, list_max(e)) - 1 AS dim, round(list_max(e), 6) AS value FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "cluster_summaries": f"{W}{PAPERS}, w AS (SELECT keyword, w, row_number() OVER (PARTITION BY keyword ORDER BY count(*) DESC, w) AS r FROM (SELECT keyword, unnest({_words('abstract', 4)}) AS w FROM papers) GROUP BY 1, 2 QUALIFY r <= 10), l AS (SELECT keyword, string_agg(w, ' ' ORDER BY r) AS words FROM w GROUP BY 1) SELECT keyword, count(*) AS size, left(arg_min(abstract, doc_id), 200) AS example, any_value(words) AS words FROM papers LEFT JOIN l USING (keyword) GROUP BY 1",
    "page_fields": "SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '<a ')) AS n_links, strlen(html) AS n_bytes FROM pages",
    "sink_stats": "SELECT count(*) AS files, round(sum(strlen(html)) / 1048576, 2) AS total_mb FROM pages",
    "access_records": "SELECT count(*) AS n, count(*) FILTER (l.quality = 1) AS with_url, count(*) FILTER (l.toxic = 1) AS retracted FROM labels l",
    "windows_sliding": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, count(*) AS n, (200 * CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) / 10000.0 AS mean FROM events, range(4) t(k) GROUP BY 1",
    "events_deduplicated": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "windows_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "windows_session": "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid",
    "revenue_by_journal_year": "SELECT o_orderpriority AS journal, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS papers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
}
ORACLES |= {f"stream_{name}": ORACLES[f"windows_{name}"] for name in ("tumbling", "sliding", "session")} | {
    "stream_deduplicated": "SELECT event_id, event_type, ts FROM events",
    "stream_breaker": """
        WITH e AS (SELECT user_id, ts, event_id, value >= 10 AS ok, sum(CAST(value >= 10 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
        r AS (SELECT user_id, island, count(*) FILTER (NOT ok) AS n, count(*) AS rows FROM e GROUP BY 1, 2)
        SELECT user_id, count(*) FILTER (n >= 3) AS opened, CAST(sum(rows) AS BIGINT) AS attempts FROM r GROUP BY 1
    """,
}

"""Operators against small models written from their definitions."""

from __future__ import annotations

import math
import random
import re
import time
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from papyrus import cli
from papyrus.functions import text as T
from papyrus.functions.stats import ranked
from papyrus.operators import attempts as A
from papyrus.operators import articles, graph, learning, retrieval, scoring, similarity
from papyrus.plans import catalog
from papyrus.streaming import events as S

SF_DIR = "/root/testdata/sf0.001"


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()


def test_tokenizer(spark):
    assert one(spark, "it's éabc abc_d abc1 abc ABC ab", T.letter_words(F.col("x")))[0] == ["abc", "abc"]
    assert one(spark, None, T.letter_words(F.col("x")), T.word_count(F.col("x")), T.readability(F.col("x")))[:] == ([], 0, 50.0)
    assert one(spark, "a,  b!", T.normalized(F.col("x")))[0] == "a b"


def test_ids(spark):
    assert one(spark, "PMID:12", T.clean_pmid(F.col("x")), T.with_pmid_prefix(F.col("x")))[:] == ("12", "PMID:12")
    assert one(spark, "7", T.with_pmid_prefix(F.col("x")), T.with_pmc_prefix(F.col("x")))[:] == ("PMID:7", "PMC7")


def chunk_model(text, size=500, overlap=50):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = [m.end() for m in re.finditer(r"[.!?]", text[start + size // 2 : end + 1])]
            end = start + size // 2 + cut[-1] if cut else end
        end = min(end, len(text))
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize("text", ["", "a", "x" * 500, "x" * 501, "x" * 250 + "." + "y" * 600, "x" * 499 + "!!" + "z" * 900, "word. " * 700])
def test_chunks(spark, text):
    assert list(retrieval.chunk_bounds(text)) == chunk_model(text)
    papers = spark.createDataFrame([(7, text), (8, None)], "doc_id long, abstract string")
    got = [tuple(r) for r in retrieval.chunks(papers, longer_than=-1).collect()]
    assert sorted(got) == [(7, k, s, text[s:e]) for k, (s, e) in enumerate(chunk_model(text))]


def test_chunks_of_a_long_text_take_linear_time():
    began = time.time()
    assert sum(1 for _ in retrieval.chunk_bounds("one two three. " * 70_000)) > 2000
    assert time.time() - began < 1


def test_question_types(spark):
    for q, want in [("How is it?", "methodological"), ("Which results?", "findings"), ("any change", "temporal"), ("the gap", "limitations"), ("what next", "future_work"), ("who", "general"), (None, "general"), ("please show", "methodological")]:
        assert one(spark, q, retrieval.question_type(F.col("x")))[0] == want


def test_scores(spark):
    assert one(spark, "[SCORE:a:8.5] [SCORE:b:1.2.3] [SCORE:a:7]", scoring.marked_scores(F.col("x")))[0] == {"a": 7.0}
    for text, want in [("7/10", 7.0), ("11/10", 5.0), ("7.5 out of 10", 7.5), ("nothing", 5.0), (None, 5.0)]:
        assert one(spark, text, scoring.fallback_score(F.col("x")))[0] == want


def articles_of(*inner):
    return articles.parse_document("<Set>" + "".join(f"<PubmedArticle><PMID>{k}</PMID><Article>{x}</Article></PubmedArticle>" for k, x in enumerate(inner)) + "</Set>")


def test_dates():
    def date(inner):
        return str(articles_of(inner)[0][5])

    assert date("<PubDate><Year>2020</Year><Month>Mar</Month><Day>5</Day></PubDate>") == "2020-03-05"
    assert date("<PubDate><Year>2020</Year><Month>Spring</Month></PubDate>") == "2020-01-01"
    assert date("<PubDate><Year>2020</Year><Month>4</Month><Day>31</Day></PubDate><ArticleDate><Year>2019</Year></ArticleDate>") == "None"
    assert date("<PubDate></PubDate><ArticleDate><Year>2019</Year></ArticleDate>") == "2019-01-01"


def test_authors_and_abstracts():
    doe, smith = "<Author><LastName>Doe</LastName></Author>", "<Author><LastName>Smith</LastName><ForeName>A</ForeName></Author>"
    found = articles_of(
        f"<AuthorList>{doe}{smith}<Author><CollectiveName>X</CollectiveName></Author></AuthorList><Abstract><AbstractText>first part</AbstractText><AbstractText Label='B'>some <i>nested</i> text</AbstractText></Abstract>",
        "<Abstract>an abstract\n without parts</Abstract>", "<OtherAbstract Type='T'>translated one</OtherAbstract><OtherAbstract>second</OtherAbstract>",
        "<Abstract><AbstractText>1234567890123456789</AbstractText></Abstract>", "<Abstract><AbstractText>12345678901234567890</AbstractText></Abstract>", f"<X>Summary: {'word ' * 300} Keywords a</X>", "",
    )
    assert found[0][3] == ["Doe", "A Smith"]
    assert [f[2] for f in found[:5]] == ["first part B: some nested text", "an abstract without parts", "[T] translated one [Other] second", None, "1" + "2345678901234567890"]
    assert len(found[5][2]) == 1000 - 1 and found[6][2] is None


def test_documents_of_articles(spark):
    rows = [("<Set><PubmedArticle><PMID>1</PMID><Article/></PubmedArticle><PubmedArticle><PMID>2</PMID></PubmedArticle></Set>",), ("<Set><PubmedArticle>",), (None,), ("",), ("<Set/>",)]
    found = articles.parse_documents(spark.createDataFrame(rows, "xml string")).collect()
    assert sorted((r["pmid"] or "", r["error"]) for r in found) == [("", articles.MALFORMED), ("1", None), ("2", "No article citation found")]


def folded(rows):
    """State and grant of each attempt, by one pass over the log in order."""
    state, tokens, out = {}, {}, {}
    for s, t, e, ok in sorted(rows):
        failures, opened = state.get(s, (0, None))
        now = "closed" if opened is None else "open" if t - opened < 300 else "half-open"
        if now != "open":
            failures = 0 if ok else failures + 1
            state[s] = (failures, None if ok else t if failures >= 3 else opened)
        rate, capacity = A.RATES.get(s, A.DEFAULT_RATE)
        have, last = tokens.get(s, (capacity, t))
        have = min(capacity, have + (t - last) * rate)
        tokens[s] = (have - (have >= 1), t)
        out[e] = (now, have >= 1)
    return out


@pytest.mark.parametrize(("every", "share"), [(20, 0.5), (200, 0.3), (3000, 0.7), (40_000, 0.2)])
def test_folds_over_a_log_of_many_days(spark, every, share):
    rng = random.Random(every)
    start, rows = datetime(2024, 1, 1, 22), []
    t = 0.0
    for e in range(1500):
        t += rng.choice([0, 1, rng.randrange(2 * every)])
        rows.append((e, rng.choice(["click", "view", "error"]), start + timedelta(seconds=t), rng.random() < share))
    df = spark.createDataFrame(rows, "event_id long, strategy string, ts timestamp, success boolean")
    want = folded([(s, ts.timestamp(), e, ok) for e, s, ts, ok in rows])
    assert {r["event_id"]: r["state"] for r in A.breaker_states(df).collect()} == {e: w[0] for e, w in want.items()}
    assert {r["event_id"]: r["granted"] for r in A.token_bucket(df).collect()} == {e: w[1] for e, w in want.items()}
    by = {s: [ok for ok in (r[3] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == s)] for s in ("click", "view", "error")}
    runs = {s: [len(list(g)) for k, g in groupby(v) if not k] for s, v in by.items()}
    assert {r["strategy"]: (r["longest"], r["opened"], r["runs"]) for r in A.breaker_runs(df).collect()} == {s: (max(v), sum(n >= 3 for n in v), len(v)) for s, v in runs.items() if v}
    rates = {s: [sum(v[: k + 1]) / (k + 1) for k in range(len(v))] for s, v in by.items()}
    assert {r["strategy"]: (r["alerts"], r["n"]) for r in A.running_rate(df).collect()} == {s: (sum(x < 0.5 for x in v[19:]), len(v)) for s, v in rates.items()}


def test_breaker(spark):
    start, ok = datetime(2024, 1, 1), [0, 0, 0, 0, 1, 1, 0, 0, 0, 1]
    gaps = [0, 1, 1, 10, 400, 1, 1, 1, 1, 1]
    rows, t = [], start
    for k, (o, g) in enumerate(zip(ok, gaps, strict=True)):
        t += timedelta(seconds=g)
        rows.append((k, "s", t, bool(o)))
    got = A.breaker_states(spark.createDataFrame(rows, "event_id long, strategy string, ts timestamp, success boolean")).orderBy("event_id").collect()
    assert [r["state"] for r in got] == ["closed"] * 3 + ["open", "half-open"] + ["closed"] * 4 + ["open"]


def test_ranks_over_blocks(spark):
    ids = [5, -3, 100, 101, 7, 250]
    got = ranked(spark.createDataFrame([(i,) for i in ids], "id long"), "id", width=10).collect()
    assert {r["id"]: r["row_no"] for r in got} == {i: k + 1 for k, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("over", [0.05, 0.4, 0.6, 0.8])
def test_jaccard_at_any_threshold(spark, monkeypatch, over):
    monkeypatch.setattr(similarity.block_pairs, "__defaults__", (7,))  # several blocks
    rows = [(k, [w for j, w in enumerate("abcdefghij") if (k * 37 + 11) >> j & 1]) for k in range(60)]
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, terms array<string>"), over).collect()}
    first = {}
    for k, s in rows:
        first.setdefault(tuple(s), k)
    sets = {k: set(s) for s, k in first.items() if s}
    assert got == {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > over}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 2), (8, 9, 1)], "src long, dst long, weight long")
    assert {r["node"]: r["component"] for r in graph.label_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert {r["node"]: r["triangles"] for r in graph.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    assert graph.summary(e).first()[:] == (6, 5, 6, 0.333333)


def test_graph_queries_take_every_edge(spark, tmp_path):
    """Suppliers that share one order only are neighbours, as in graph_density."""
    lines = [(o, s) for o, group in enumerate([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)]) for s in group]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = catalog.queries()
    assert {tuple(r) for r in q["components"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert {tuple(r) for r in q["clustering_coeff"](spark, str(tmp_path)).collect()} == {(1, 2, 1, 1.0), (2, 2, 1, 1.0), (3, 3, 1, 0.333333), (4, 1, 0, 0.0), (8, 1, 0, 0.0), (9, 1, 0, 0.0)}


def test_elbow():
    assert learning.elbow([(2, 100.0), (3, 50.0), (4, 45.0), (5, 44.0)]) == 3
    assert learning.elbow([(2, 10.0)]) == 2


def test_closed_windows_equal_the_batch(spark):
    batch = {(r["start"], r["event_type"]): r["n"] for r in S.tumbling(catalog._events(spark, SF_DIR)).collect()}
    stream = {(r["start"], r["event_type"]): r["n"] for r in S.run(S.tumbling(S.source(spark, SF_DIR))).collect()}
    assert stream.items() <= batch.items() and len(stream) > 0.9 * len(batch)


@pytest.mark.parametrize(("args", "names"), [(["abstracts", "--term", "the", "--limit", "7"], {"papers": 7, "coverage": 1}), (["full", "--streaming"], {"coverage": 1, "sentiment": 200, "attempts": None}), (["markdown"], {"conversion": 1, "markdown": None})])
def test_jobs(spark, tmp_path, args, names):
    cli.main([*args, "--data", SF_DIR, "--out", f"file://{tmp_path}"], spark)
    for name, rows in names.items():
        n = spark.read.json(f"file://{tmp_path}/{name}").count()
        assert n == rows if rows is not None else n > 0


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    for name in ("jaccard_pairs", "term_cooccurrence", "id_enrichment", "retry_fold"):
        assert "CartesianProduct" not in plan_of(catalog.queries()[name](spark, SF_DIR))
    plan = plan_of(catalog.queries()["years_in_text"](spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<text:string>", plan)


def test_blocks_meet_without_a_shuffle_of_copies(spark, monkeypatch):
    """Blocks are written once; no plan shuffles a copy for each block, and rare terms count like frequent ones."""
    from papyrus.operators import similarity

    rng = random.Random(4)
    sets = [(k, sorted({f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 30))})) for k in range(150)]
    df = spark.createDataFrame(sets, "doc_id long, terms array<string>")
    for dense, block in ((4096, 4096), (7, 16)):
        monkeypatch.setattr(similarity, "DENSE", dense)
        monkeypatch.setattr(similarity, "STRIP", 5)
        monkeypatch.setattr(similarity.block_pairs, "__defaults__", (block,))
        found = similarity.jaccard_pairs(df, 0.3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        reps = {}
        for k, t in sets:
            reps.setdefault(tuple(t), k)
        reps = [(k, set(t)) for t, k in reps.items()]
        want = {(a, b, len(s & t), len(s | t)) for a, s in reps for b, t in reps if a < b and len(s & t) / len(s | t) > 0.3}
        got = [(r["a"], r["b"], r["shared"], r["total"]) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)


def test_rows_of_blocks_are_combined_in_tasks(spark, monkeypatch):
    """A vector leaves a task once for each label, not once for each block."""
    import pandas as pd

    from papyrus.operators import similarity

    monkeypatch.setattr(similarity, "COMBINED", 2)
    df = spark.range(120).select("id", (F.col("id") % 3).alias("label"))

    def counted(left, right, same):
        sides = ((left, right),) if same else ((left, right), (right, left))
        return pd.DataFrame([(i, int(o), 1) for x, y in sides for i in x["id"] for o in y["v"]], columns=["id", "other", "n"])

    for most in (10**6, 100):
        monkeypatch.setattr(similarity, "COMBINED_ROWS", most)
        found = similarity.block_pairs(df, "id", F.col("label"), "id long, other long, n long", counted, 8, combine=lambda rows: rows.groupby(["id", "other"], as_index=False)["n"].sum())
        rows = [tuple(r) for r in found.collect()]
        total = {}
        for i, o, n in rows:
            total[i, o] = total.get((i, o), 0) + n
        assert total == {(i, o): 40 for i in range(120) for o in range(3)}
        assert most == 100 or len(rows) <= 120 * 3 * 3  # of two partitions three pairs hold a vector


def test_nearest_by_products(spark, monkeypatch):
    """Many equal scores, scores a rounding step apart, null vectors and null kinds, over several blocks; nothing is shuffled before the scores."""
    from papyrus.operators import similarity

    monkeypatch.setattr(similarity, "QUERY_ROWS", 5)
    monkeypatch.setattr(similarity, "VECTOR_ROWS", 20)
    rng = random.Random(9)
    vectors = [(k, rng.choice([0, 1, None]), [1.0, 0.5, 0.0] if k % 3 == 0 else [1.0, 0.5 + rng.randrange(4) * 1e-6, 0.0] if k % 3 == 1 else [rng.gauss(0, 1) for _ in range(3)]) for k in range(140)]
    vectors += [(200, 0, None), (201, 5, [0.0, 0.0, 0.0]), (202, 5, None), (203, 5, None)]
    queries = [(k, v) for k, _, v in vectors if k % 10 == 0]
    df = spark.createDataFrame(vectors, "id long, kind int, v array<double>")
    asked = spark.createDataFrame(queries, "query_id long, q array<double>")
    found = similarity.nearest(asked, df, 3)
    scored = df.select("id", "kind", similarity.unit(F.col("v")).alias("v")).crossJoin(asked.select("query_id", similarity.unit(F.col("q")).alias("q"))).select("query_id", "kind", "id", F.round(similarity.inner(F.col("q"), F.col("v")), 6).alias("score"))
    groups = {}
    for r in scored.collect():
        groups.setdefault((r["query_id"], r["kind"]), []).append((r["score"] is None, -(r["score"] or 0.0), r["id"]))
    want = {(*g, i, n + 1, None if none else -s + 0.0) for g, rows in groups.items() for n, (none, s, i) in enumerate(sorted(rows)[:3])}
    got = [(r["query_id"], r["kind"], r["id"], r["rank"], r["score"] if r["score"] is None else r["score"] + 0.0) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_tfidf_counts_terms_in_their_rows(spark):
    """Neither a paper's terms nor its weights are shuffled: only distinct terms are."""
    from papyrus.operators import frequency

    papers = spark.createDataFrame([(1, "river delta river stone"), (2, "stone river"), (3, "delta stone stone"), (4, None), (5, "only once here")], "doc_id long, abstract string")
    found = frequency.tfidf(papers, k=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["rank"]): (r["term"], r["weight"]) for r in found.collect()}
    idf = {"river": math.log(6 / 3) + 1, "stone": math.log(6 / 4) + 1, "delta": math.log(6 / 3) + 1}
    want = {}
    for doc, tf in ((1, {"river": 2, "delta": 1, "stone": 1}), (2, {"river": 1, "stone": 1}), (3, {"delta": 1, "stone": 2})):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        for rank, (w, t) in enumerate(sorted((-round(n * idf[t] / norm, 6), t) for t, n in tf.items())[:2], 1):
            want[doc, rank] = (t, -w)
    assert got == want

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrus.llm import queries, secrets


def brute(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans():
    for t in ["Token = abcdefghijklmnop", "password: token: abcdefghijklmnop", "api_key='AKIA" + "A" * 14 + "'", "AKIAAKIA" + "B" * 9, "x" + "0123456789abcdef" * 2, "ſecret=abcdefghijklmnop", "passwd=short token=" + "z" * 12, ""]:
        assert secrets.base_spans(t) == brute(t)


def test_query_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op10_secret_scan(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        spans = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("network")] == [s for s in joined.split(",") if s]


@pytest.fixture(scope="module")
def findings():
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    out = []
    for k in range(400):
        secret, mail = "".join(rng.choice(letters, 32)), f"user.name{k}.example.com{k % 10}"
        for body, y, front in ((secret, 1, ["token = \"", "key is "][k % 2]), (mail, 0, "write to ")):
            text = f"some words before {front}{body} and after it"
            at = text.index(body)
            out.append((secrets.window(text, at, at + len(body)), y))
    return out


def test_network_on_held_out_findings(findings):
    net = secrets.train(findings[:600])
    codes, truth = secrets._codes([w for w, _ in findings[600:]]), np.array([y for _, y in findings[600:]])
    said = net.probability(codes) >= net.threshold
    assert said[truth == 1].mean() >= 0.95 and said[truth == 0].mean() <= 0.05
    assert secrets.train(findings[:10]) is None


def random_key(rng, n=32):
    return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))


def test_secrets_outside_the_patterns_are_not_learned_as_clean(findings):
    """A third of the candidates that no pattern touches are keys in plain prose; most keys like them are found all the same."""
    rng = np.random.default_rng(9)
    hidden = [(secrets.window(f"we met {k} near the old mill", 7, 39), 0) for k in (random_key(rng) for _ in range(150))]
    net = secrets.train(findings[:600] + hidden)
    fresh = [f"we met {random_key(rng)} near the old mill" for _ in range(100)]
    assert sum(secrets.find_spans(t, net)[0] == [("network", 7, 39)] for t in fresh) >= 70
    assert sum(bool(secrets.find_spans(f"write to user.name{k}.example.com{k % 10} and after it", net)[0]) for k in range(400, 500)) <= 5


def test_keys_are_taken_whole(findings):
    """A key around a run of hex digits, and one within a long candidate, in front, in the middle or at the end."""
    net, rng = secrets.train(findings[:600]), np.random.default_rng(11)
    whole = middle = 0
    for _ in range(40):
        key = random_key(rng, 20) + "0123456789abcdef" + random_key(rng, 12)
        whole += secrets.masked(f"key is {key} and after it", secrets.find_spans(f"key is {key} and after it", net)[0]) == "key is [SECRET] and after it"
        dull = ".".join(f"name{k}" for k in range(12))
        middle += all(secrets.find_spans(f"write to {t} and", net)[0] == [("network", 9, 9 + len(t))] for t in (f"{dull}={random_key(rng, 60)}={dull}", f"{random_key(rng, 60)}={dull}", f"{dull}={random_key(rng, 60)}"))
    assert whole >= 36 and middle >= 36
    text = "x" * 70 + "1" * 60 + "y" * 3
    parts = secrets.windows(text, 5, 131)
    assert parts[0][24:72] == text[5:53] and parts[-1][24:72] == text[83:131] and all(len(p) == secrets.WINDOW for p in parts)
    assert not secrets._covered((5, 20), secrets._union([("hex", 0, 12), ("hex", 13, 30)])) and secrets._covered((5, 20), secrets._union([("hex", 0, 12), ("assign", 12, 30)]))


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=8), st.integers(0, 50), st.integers(1, 10))
def test_touching_and_covering_by_characters(spans, start, length):
    spans = sorted(("hex", s, s + n) for s, n in spans)
    held = {i for _, s, e in spans for i in range(s, e)}
    own, union = set(range(start, start + length)), secrets._union(spans)
    assert secrets._touches((start, start + length), union) == bool(own & held)
    assert secrets._covered((start, start + length), union) == (own <= held)


def test_planted_keys_that_no_pattern_matches(spark):
    """Keys of letters and digits in the given documents' prose: the network, trained on their hexadecimal findings alone, finds most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    found = secrets.labelled_findings(docs)
    net = secrets.train(found)
    assert all(share >= 0.95 - 1e-9 for group, (_, share) in net.report.items() if group not in ("clean", "look-alikes"))
    assert net.report["look-alikes"][1] <= 0.05
    rng, hits, texts = np.random.default_rng(1), 0, [r[0] for r in docs.collect() if r[0] and len(r[0]) > 300]
    for text in texts[:100]:
        key, at = random_key(rng), text.index(" ", 100) + 1
        spans, _ = secrets.find_spans(text[:at] + key + " " + text[at:], net)
        hits += any(k == "network" and s <= at and at + len(key) <= e for k, s, e in spans)
    assert hits >= 80
    assert sum(any(k == "network" for k, _, _ in secrets.find_spans(t, net)[0]) for t in texts) <= 0.01 * len(texts)


def test_very_many_candidates_in_one_text(findings):
    net, text = secrets.train(findings[:600]), " ".join(f"ab{k}cd.example{k}.com" for k in range(100_000))
    began = time.process_time()
    secrets.find_spans(text, net)
    spans = secrets.base_spans(" ".join(f"{k * 7919:016x}" for k in range(100_000)))
    union = secrets._union(spans)
    assert all(secrets._touches(s[1:], union) and secrets._covered(s[1:], union) for s in spans)
    assert time.process_time() - began < 120


def test_recall_alone_sets_the_threshold(findings):
    """Also where the network finds many held-out secrets unlikely, and where only those without their context are."""
    codes, truth = secrets._codes([w for w, _ in findings]), np.array([y for _, y in findings])
    net = secrets.train(findings)
    mixed = np.concatenate([codes[truth == 1], codes[truth == 0][:100]])
    net.calibrate(np.concatenate([mixed, codes[truth == 0]]), np.repeat([1, 0], [len(mixed), (truth == 0).sum()]), 0.95)
    assert net.threshold < 0.5 and (net.probability(mixed) >= net.threshold).mean() >= 0.95
    net.calibrate(codes, truth, 0.95, (codes[truth == 0][:50],))
    assert (net.probability(codes[truth == 0][:50]) >= net.threshold).mean() >= 0.95


def test_masking(spark, odd_docs, no_docs):
    rows = [(1, "a token = \"0123456789abcdef01234567\" b", 99, "x"), (2, None, None, "y"), (3, "clean", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    assert sorted(tuple(r) for r in secrets.mask_secrets(df).collect()) == [(1, "a [SECRET]\" b", 13, "x"), (2, None, None, "y"), (3, "clean", 5, None)]
    assert secrets.mask_secrets(odd_docs).columns == odd_docs.columns
    assert secrets.mask_secrets(no_docs).count() == 0


def test_odd_rows(odd_docs, no_docs):
    found = secrets.scan(odd_docs)
    assert found.count() == odd_docs.count()
    assert found.where(F.col("doc_id") == 1).select("spans", "masked").first()[:] == ("", "")
    assert secrets.scan(no_docs).count() == 0


def test_copies_of_a_row_change_no_learned_window(spark):
    """Windows count once: many copies of one secret, a row a batch, leave the sample of the others as it is."""
    rng = np.random.default_rng(5)
    own = [(f"the key {''.join(rng.choice(list('0123456789abcdef'), 32))} number {k}",) for k in range(60)]
    prose = [(f"plain words of text {k} that go on for a good while so that they fill a whole window of the network and some more beyond its end",) for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        once = secrets.labelled_findings(spark.createDataFrame(own + prose, "text string"), most=50)
        copies = secrets.labelled_findings(spark.createDataFrame((own + prose + own[:1] * 2000), "text string").repartition(3), most=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert once == copies and sum(y == secrets.SECRET for _, y in once) == 50 and len({w for w, _ in once}) == len(once)


def test_a_column_says_whether_a_network_was_used(spark):
    few = secrets.scan(spark.createDataFrame([(1, "a 0123456789abcdef0123 b")], "doc_id long, text string")).collect()
    assert [r["network"] for r in few] == [False] and few[0]["n_hex"] == 1


def test_all_findings_are_learned_from(spark):
    """More different secrets and stretches of text than were once sampled, more rows than a unit: each is in one unit, the held-out ones are all scored."""
    rng = np.random.default_rng(5)
    own = [(f"the key {''.join(rng.choice(list('0123456789abcdef'), 32))} number {k}",) for k in range(1700)]
    prose = [(f"plain words of text {k} that go on for a good while so that they fill a whole window of the network and some more beyond its end",) for k in range(100)]
    docs = spark.createDataFrame(own + own[:300] + prose, "text string").repartition(3)
    found = secrets.findings(docs)
    assert len(secrets.labelled_findings(docs)) == found.count() >= 1750
    held = {r["label"]: r["count"] for r in found.where("held").groupBy("label").count().collect()}
    net = secrets.train_on(docs, unit=600)
    assert net.report["own context"][0] == held[secrets.SECRET]
    assert all(share >= 0.95 - 1e-9 for group, (_, share) in net.report.items() if group not in ("clean", "look-alikes"))
    units = secrets._Units(found, {y: n for y, n in found.groupBy("label").count().collect()}, 600, 0.95)
    for halves in (False, True):
        dealt = units._dealt(found, halves)
        first = dealt.where("copy = 0")
        assert first.select("seen", "label").distinct().count() == found.count()
        assert first.groupBy("net", "seen", "label").count().where("count > 1").count() == 0
        assert dealt.groupBy("net", "unit").agg(F.countDistinct("label").alias("n")).where("n < 2").count() == 0


def test_threshold_from_counts_keeps_the_recall():
    rng = np.random.default_rng(3)
    logits = {"own context": rng.normal(2, 2, 400), "no context": rng.normal(-1, 1, 90), "clean": rng.normal(-4, 1, 500)}
    for sign in (1, -1):
        net = secrets.CharNet()
        net.calibrate_counts({g: np.unique(np.floor(sign * x * secrets.STEP).astype(int), return_counts=True) for g, x in logits.items()}, 0.95)
        for group in ("own context", "no context"):
            p = 1 / (1 + np.exp(-np.clip(net.scale * sign * logits[group] + net.shift, -30, 30)))
            assert (p >= net.threshold).mean() >= 0.95 and net.report[group][0] == len(p)
        assert min(net.report[g][1] for g in ("own context", "no context")) <= 0.97

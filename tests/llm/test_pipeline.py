from __future__ import annotations

import corpus_pipeline
from test_packing import check

from papyrus.llm import quality, secrets, simhash


def test_pipeline_by_its_operators(spark, sf_dir):
    """What is left after each stage, computed from the operators' own results, is what is packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r["kept"]}
    good = docs.where(docs.doc_id.isin(list(kept)))
    groups = simhash.near_duplicates(good).collect()
    first = {r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]}
    assert 0 < len(first) < len(kept) < docs.count()
    left = good.where(good.doc_id.isin(list(first)))
    net = secrets.train(secrets.labelled_findings(left))
    texts = {r["doc_id"]: secrets.masked(r["text"], secrets.find_spans(r["text"], net)[0]) for r in left.collect()}
    check([r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()], texts, most_padding=0.01)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, ties and repeated rows, and columns with names that operators use inside."""
    names = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, spans string, row string, label string"
    long_text = " ".join(f"word{k} of a long text" for k in range(30_000))
    prose = " ".join(f"an ordinary{k} sentence about{k} something" for k in range(20))
    rows = [(1, None, None, None, None), (None, prose, "en", "s", 1), (2, "", "en", "s", 0), (3, prose, "en", "s", 9), (3, prose, "en", "s", 9), (4, prose, None, None, None), (5, long_text, "en", "s", 9), (6, "x" * 300_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "f", None, "s", "r", "l") for r in rows], names)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} <= {None, 3, 4, 5}
    left = sorted((r["doc_id"] or 0 for r in stages["near_dedup"](spark, docs, sf_dir).collect()))
    assert left == [0, 1, 3, 5, 6]  # 2 has the fingerprint of 1, 4 that of 3, whose repeated row goes
    masked = stages["secret_masking"](spark, docs, sf_dir)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert [r["text"] for r in masked.where("doc_id = 1").collect()] == [None]
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows) and {r["doc_tokens"] for r in pieces if r["doc_id"] in (1, 2)} == {1}

from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fp string, bucket string, row string"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id -> text of the smallest table."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that operators use inside."""
    rows = [(1, None, None, None, None, None), (None, "no id", "en", "x", "y", "z"), (2, "", "en", "x", "y", "z"), (3, " \n\t", "en", "x", "y", "z"), (4, "same words here " * 30, "en", "x", "y", "z"), (4, "same words here " * 30, "en", "x", "y", "z"), (5, "long text with words é " * 20_000, "en", "x", "y", "z"), (6, "x" * 100_000, "en", None, "y", "z"), (-7, "▁ 日本 \x00 \x1c end", "en", "x", "y", "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

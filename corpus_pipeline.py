"""Training-data pipeline over documents: quality rules, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows are written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.llm import packing, quality, secrets, simhash
from papyrus.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; a null text counts as empty and is rejected, repeated rows share their verdict, rows without an id are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Of repeated rows with that id one stays; rows without an id stay."""
    return simhash.drop_near_duplicates(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked and n_chars follows; no document goes, null texts stay null, repeated rows are masked alike."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's tokens, as op1 returns them. A null text is the end id alone; every row is a document, also repeated ones and those without an id."""
    pieces = packing.pack_documents(docs, packing.word_tokenizer(), capacity=2048, eos_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_masking", secret_masking), ("packing", pack)]

#: The fingerprints (XXH64) and the trained classifier have no form in SQL.
ORACLE_SQL = None


def _forget(spark: SparkSession, path: str) -> None:
    """Removes a folder that this run has written and that no later stage reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder; a stage's rows are removed once those of the next are there. The result reads the last written ones."""
    docs, last = table(spark, sf_dir, "documents"), None
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if last:
            _forget(spark, last)
        last = f"{where}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

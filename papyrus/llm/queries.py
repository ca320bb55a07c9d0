"""The queries of this subpackage: name -> function(spark, sf_dir), each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.llm import align, chat, itq, licenses, multiset, packing, pieces, quality, repair, secrets, simhash, sitetree, warc
from papyrus.llm.common import shared_dir, table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.word_tokenizer(), capacity=2048, eos_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-1) whose texts are control strings; every prefix is rendered whole."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(given.unionByName(own)))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, tau=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(table(spark, sf_dir, "pages"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.sample_pieces(table(spark, sf_dir, "documents"), pieces.model_path(), seed=42)
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC files to the shared folder and reads them back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path, "record_type in ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), with_masked=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "n_confirmed", "network")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_statistics(table(spark, sf_dir, "documents"), *align.tokenizer_paths())


def op12_itq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair.digests(repair.repair(repair.damage(given), all_ids=given.select("conv_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_harmonic_packing, op2_quality_rules, op3_chat_format, op4_simhash_pigeonring, op5_site_style_tree, op6_sampled_pieces, op7_licence_scan, op8_warc_archive, op9_multiset_hash, op10_secret_scan, op11_token_alignment, op12_itq_neighbours, op13_turn_repair)
    return {f.__name__: f for f in own}


#: DuckDB SQL for the queries that SQL can express.
ORACLES = {
    "op8_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM f
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

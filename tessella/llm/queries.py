"""The thin queries of the ten operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, blocks, decontam, packing, pfor, pii, substring, toxicity, warc, webp
from .common import table, written
from .tokens import tokenizer_path

TOKEN_FILE, TOKEN_END = "word_bpe_49k.json", 2
PACK_FILE, PACK_END = "byte_bpe_50k.json", 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_tokens(pfor.write_tokens(documents(spark, sf_dir), tokenizer_path(TOKEN_FILE), TOKEN_END))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write(warc.ordered(warc.chunk_table(table(spark, sf_dir, "pages", "page_id", "url", "html")))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), tokenizer_path(PACK_FILE), PACK_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.report(documents(spark, sf_dir))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(written(webp.media(documents(spark, sf_dir)), "media"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_decontamination, op4_toxicity, op5_token_files, op6_warc, op7_packing, op8_html_blocks, op9_bagminhash, op10_webp)}

ORACLE_SQL = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN m.response IS NULL OR m.response = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m.response <> d.page_id THEN m.response END AS refers_to
        FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
    """,
}

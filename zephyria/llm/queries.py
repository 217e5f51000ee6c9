"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zephyria.llm.bpe_stream import round_trip_digests
from zephyria.llm.common import table
from zephyria.llm.exact_dedup import duplicate_report
from zephyria.llm.html_extract import extract_main
from zephyria.llm.merkle import merkle_manifest
from zephyria.llm.merkle_sql import MANIFEST_SQL
from zephyria.llm.ngram_join import near_duplicate_report
from zephyria.llm.packing import pack_documents
from zephyria.llm.quality_cnn import quality_scores
from zephyria.llm.quality_rules import quality_rules
from zephyria.llm.registry import query
from zephyria.llm.sharding import SHARD_BYTES, shard_report
from zephyria.llm.suffix_dedup import repeat_report
from zephyria.llm.token_align import cross_alignment
from zephyria.llm.token_count import token_counts
from zephyria.llm.vector_near import near_vectors

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@query(
    "op2_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents
    )
    SELECT doc_id,
           min(doc_id) OVER (PARTITION BY h) AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY h) AS kept,
           h AS text_sha256
    FROM d
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts; the smallest doc_id stays."""
    return duplicate_report(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, BYTE_BPE).drop("text")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence and place of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_digests(docs, BYTE_BPE).drop("text")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and compression bands of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


@query(
    "op10_sharding",
    f"""
    WITH d AS (
      SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits
      FROM documents
    ), prefixes AS (
      SELECT doc_id, n_bytes, bits, depth, bits >> (60 - depth) AS bucket FROM d, range(0, 41) AS r(depth)
    ), sized AS (
      SELECT *, sum(n_bytes) OVER (PARTITION BY depth, bucket) AS shard_bytes,
             count(*) OVER (PARTITION BY depth, bucket) AS n_rows
      FROM prefixes
    ), leaf AS (
      SELECT * FROM sized WHERE shard_bytes <= {SHARD_BYTES} OR n_rows = 1
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
    )
    SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
           CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || to_base(bucket, 2), depth::INT) END AS shard,
           CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes
    FROM leaf
    """,
)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard_report(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 100-byte strings that start earlier."""
    return repeat_report(table(spark, sf_dir, "documents")).drop("removed")


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of linked documents that every document is in."""
    return near_duplicate_report(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf, roots and proof of every document, checked against tampering."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give every document."""
    return cross_alignment(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


@query("op12_embedding_near_dedup")
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors with a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

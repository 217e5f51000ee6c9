"""Raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zephyria.llm.common import stored, table
from zephyria.llm.exact_dedup import keep_first
from zephyria.llm.ngram_join import keep_one
from zephyria.llm.packing import pack_documents
from zephyria.llm.quality_rules import keep_good
from zephyria.llm.suffix_dedup import cut_repeats

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shingle links connect."""
    return keep_one(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of what is left."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("near_copies", near_copies),
    ("long_repeats", long_repeats),
    ("packing", packing),
]

#: Compression, shingle links, cut bytes and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

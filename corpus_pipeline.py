"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardlens.durable import durable_folder
from shardlens.llm import bpe, language, line_dedup, minhash, mixing
from shardlens.llm.common import in_small_batches
from shardlens.llm.registered import BYTE_RANKS, PIECES


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that read like no learned language (see `known_language`)."""
    return language.known_language(in_small_batches(docs), language.learn(docs, PIECES))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller doc_id holds go; n_chars follows the text."""
    return line_dedup.deduplicated(docs, line_dedup.store_of(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the smallest doc_id stays."""
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    found = bpe.encode_digests(in_small_batches(docs), BYTE_RANKS, public_tokenizers.PATTERN)
    return found.select(bpe.back_to_doc_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# Segmentation models, MinHash buckets and byte-level merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    folder = f"{durable_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Records of shards: the lines of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINE_BREAK = "\n"


def lines_of(text: Column | str) -> Column:
    return F.split(text, LINE_BREAK, -1)


def explode_records(shards: DataFrame, text: str = "text", uri_of: str = "doc_id") -> DataFrame:
    """One row per line: other columns kept, plus uri (`doc_id#line`) and text."""
    kept = [c for c in shards.columns if c != text]
    return shards.select(*kept, F.posexplode(lines_of(text)).alias("_pos", "_line")).select(
        *kept,
        F.concat_ws("#", F.col(uri_of).cast("string"), "_pos").alias("uri"),
        F.col("_line").alias("text"),
    )


def scan_records(documents: DataFrame) -> DataFrame:
    """(md5, uri, text) of every line of every document."""
    return explode_records(
        documents.select(F.md5("text").alias("md5"), "doc_id", "text")
    ).select("md5", "uri", "text")


def record_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, md5, num_of_records, decompressed_byte_size) of every document."""
    return documents.select(
        "doc_id",
        F.md5("text").alias("md5"),
        F.size(lines_of("text")).alias("num_of_records"),
        F.octet_length("text").cast("bigint").alias("decompressed_byte_size"),
    )

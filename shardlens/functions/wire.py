"""JSON messages: camel-case names, NULLs left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of columns in messages. `has_more` and `bytesize` keep their names.
WIRE_NAMES = {
    "query_id": "queryId",
    "query_text": "queryText",
    "created_at": "createdAt",
    "page_size": "pageSize",
    "data_url": "dataUrl",
    "batch_size": "batchSize",
    "decompressed_byte_size": "decompressedByteSize",
    "checksum_md5": "checksumMd5",
    "classifier_id": "classifierId",
}


def wire_struct(columns: list[str], **values: Column) -> Column:
    """A struct with the names of messages; `values` stand in for columns of their names."""
    return F.struct(*[values.get(c, F.col(c)).alias(WIRE_NAMES.get(c, c)) for c in columns])


def to_wire(df: DataFrame, columns: list[str] | None = None, name: str = "body") -> DataFrame:
    """Add the JSON text of `columns` (all by default) as column `name`."""
    return df.withColumn(name, F.to_json(wire_struct(columns or df.columns)))

"""Stored tables: catalogue, queries, jobs and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# How each table is cut into files. The last column of a list is unique or
# nearly so, which lets a large language or query spread over many files.
FILE_ORDER = {
    "datasets": ["language", "name", "md5"],
    "query_results": ["query_id", "data_id"],
}
# Folders are named by a marked copy of this column. A folder's name is read
# back as whatever it looks like; behind the mark, an empty, numeric or date-like value
# stays a text, and the column itself lies in the files as it was.
PARTITION_SOURCE = {"datasets": "language"}
PARTITION = "folder"
_MARK = "="


def folder_of(value: Column | str) -> Column:
    return F.concat(F.lit(_MARK), F.col(value) if isinstance(value, str) else value)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write a new snapshot of `table`. Refuses to overwrite an existing one."""
    order, source = FILE_ORDER.get(table), PARTITION_SOURCE.get(table)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = (df.withColumn(PARTITION, folder_of(source)) if source else df).write.mode("errorifexists")
    (writer.partitionBy(PARTITION) if source else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A snapshot. With its `schema`, one without any row can be read as well."""
    return _with_folder(spark, path, schema).drop(PARTITION)


def _with_folder(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def scan_catalog(
    spark: SparkSession, path: str, name: str | None = None, language: str | None = None
) -> DataFrame:
    """Shards of one dataset and language; both filters reach the scan."""
    catalog = _with_folder(spark, path, None)
    if name is not None:
        catalog = catalog.where(F.col("name") == name)
    if language is not None:
        catalog = catalog.where((F.col(PARTITION) == _MARK + language) & (F.col("language") == language))
    return catalog.drop(PARTITION)

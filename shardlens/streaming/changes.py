"""Folders of changes, one per micro-batch, and their folding into one.

A micro-batch writes `<out>/batch_id=<n>` and reads nothing that earlier ones
wrote, so its cost follows its own size; a replayed one replaces itself. Readers
reduce over the batches. Folding a finished run of batches into one table keeps that
cheap; readers then take the folded table and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Fold = Callable[[DataFrame], DataFrame]


def write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def read_changes(
    spark: SparkSession, out: str, schema: str, base: str | None = None, after: int = -1
) -> DataFrame:
    """All changes of `schema` with their batch_id; with `base`, its rows and the batches after `after`.

    A folder without any batch yet is empty.
    """
    full = f"{schema}, batch_id bigint"
    rows = spark.read.schema(full).option("ignoreMissingFiles", "true").option(
        "basePath", out
    ).parquet(out) if _exists(spark, out) else spark.createDataFrame([], full)
    if base is None:
        return rows
    return spark.read.schema(full).parquet(base).unionByName(rows.where(F.col("batch_id") > after))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def fold_changes(
    spark: SparkSession, out: str, schema: str, fold: Fold, target: str, upto: int,
    base: str | None = None, after: int = -1,
) -> None:
    """Write to `target` what the batches up to `upto` come to, on top of an earlier `base`."""
    rows = read_changes(spark, out, schema, base, after).where(F.col("batch_id") <= upto)
    fold(rows).write.mode("errorifexists").parquet(target)

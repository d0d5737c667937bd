"""Dataset statistics kept up to date by what changed, without reading the catalogue again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.operators.ingest import STATS_KEYS
from shardlens.streaming.changes import fold_changes, read_changes, write_batch

CHANGES = "language string, data_type string, name string, objects bigint, records bigint, bytes bigint"


def signed_counts(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """What shards that come and shards that go do to each group: a row per group, with signs.

    A group whose sums all come to nothing has no row. A NULL size or number of records counts nothing.
    """
    rows = _signed(added, 1)
    if removed is not None:
        rows = rows.unionByName(_signed(removed, -1))
    return _summed(rows)


def _signed(shards: DataFrame, sign: int) -> DataFrame:
    def signed(value) -> F.Column:
        return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")) * sign

    return shards.select(
        *STATS_KEYS, F.lit(sign).cast("bigint").alias("objects"),
        signed(F.col("num_of_records")).alias("records"), signed(F.col("byte_size")).alias("bytes"),
    )


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*STATS_KEYS).agg(*[F.sum(c).alias(c) for c in ("objects", "records", "bytes")])
    return sums.where("objects <> 0 OR records <> 0 OR bytes <> 0")


def record_changes(out: str, batch_id: int, added: DataFrame, removed: DataFrame | None = None) -> None:
    """Store the changes of one batch. A batch that is played again replaces itself."""
    write_batch(signed_counts(added, removed), out, batch_id)


def running_stats(spark: SparkSession, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """Objects, records and bytes of every group that has any.

    With `base`, a folded table, only batches after `after` are added to it, so a
    batch that is played again once it has been folded changes nothing.
    """
    return _summed(read_changes(spark, out, CHANGES, base, after).drop("batch_id")).where("objects <> 0")


def fold_stats(
    spark: SparkSession, out: str, target: str, upto: int, base: str | None = None, after: int = -1
) -> None:
    """Fold the batches up to `upto` into one table with a row for each group."""
    fold_changes(
        spark, out, CHANGES,
        lambda rows: _summed(rows.drop("batch_id")).withColumn("batch_id", F.lit(upto).cast("bigint")),
        target, upto, base, after,
    )

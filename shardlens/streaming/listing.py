"""Object listings as a stream: a catalogue that grows with every inventory file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shardlens.operators.constraints import check_constraints
from shardlens.operators.ingest import CATALOG_COLUMNS, catalog_rows, load_rejects
from shardlens.operators.keyed import first_per_key
from shardlens.schemas import LISTING
from shardlens.sources.live import SETTLE, read_live
from shardlens.streaming.changes import fold_changes, read_changes, write_batch

STORED_CATALOG = (
    "name string, language string, data_type string, md5 string, num_of_records int, "
    "decompressed_byte_size bigint, byte_size bigint, source string, created_at timestamp"
)
STORED_REJECTS = "key string, size bigint, reasons array<string>"


def listing_stream(
    spark: SparkSession,
    path: str,
    catalog_path: str,
    checkpoint: str,
    as_of: Column | None = None,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store the shards of new inventory files below `path`, batch by batch.

    The checkpoint remembers the files done, in place of a last key. A
    micro-batch writes the first row of each of its shards and reads no other
    batch; of a shard that several batches list, readers take the earliest.
    Objects that cannot be taken go to `<catalog_path>-rejected`, with reasons.
    """
    listed = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return _store_listed(listed, catalog_path, checkpoint, as_of, trigger)


def live_listing_stream(
    spark: SparkSession,
    root: str,
    catalog_path: str,
    checkpoint: str,
    prefixes: list[str] | None = None,
    settle: float = SETTLE,
    as_of: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store the shards of objects that come or change below the folder `root`, without inventories.

    See `LiveListing` for `prefixes` and `settle`; batches are stored as by `listing_stream`.
    """
    return _store_listed(read_live(spark, root, prefixes, settle), catalog_path, checkpoint, as_of, trigger)


def _store_listed(
    listing: DataFrame, catalog_path: str, checkpoint: str, as_of: Column | None, trigger: dict | None
) -> StreamingQuery:
    def save(listed: DataFrame, batch_id: int) -> None:
        batch = listed.persist()  # read twice
        rows, _ = check_constraints(
            catalog_rows(batch, F.current_timestamp() if as_of is None else as_of), "datasets"
        )
        first = first_per_key(rows, ["md5"], [F.col("key")])
        write_batch(first.select(*CATALOG_COLUMNS), catalog_path, batch_id)
        write_batch(load_rejects(batch), f"{catalog_path}-rejected", batch_id)
        batch.unpersist()

    return (
        listing.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(save)
        .start()
    )


def _earliest(rows: DataFrame) -> DataFrame:
    return first_per_key(rows, ["md5"], [F.col("batch_id")])


def read_streamed_catalog(
    spark: SparkSession, catalog_path: str, base: str | None = None, after: int = -1
) -> DataFrame:
    """Each shard once, from the earliest batch that listed it (its `batch_id`)."""
    return _earliest(read_changes(spark, catalog_path, STORED_CATALOG, base, after))


def fold_catalog(
    spark: SparkSession, catalog_path: str, target: str, upto: int, base: str | None = None, after: int = -1
) -> None:
    """Fold the batches up to `upto` into one table with a row for each shard."""
    fold_changes(spark, catalog_path, STORED_CATALOG, _earliest, target, upto, base, after)


def rejected_listings(spark: SparkSession, catalog_path: str) -> DataFrame:
    """(key, size, reasons, batch_id) of all objects that were set aside."""
    return read_changes(spark, f"{catalog_path}-rejected", STORED_REJECTS)

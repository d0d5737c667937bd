"""From queries and the catalogue to batches of classifier jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.functions.keys import object_key
from shardlens.functions.wire import wire_struct
from shardlens.operators.lookup import BROADCAST_BYTES, lookup_join
from shardlens.operators.numbering import number_rows
from shardlens.schemas import BATCH_SIZE, PENDING

CONTEXT = ["data_url", "batch_size", "bytesize", "decompressed_byte_size", "checksum_md5", "classifier_id"]


def fan_out(
    queries: DataFrame, catalog: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every query with every shard of its dataset and language.

    The data type plays no part, and a NULL language matches no shard.
    """
    wanted = queries.select(F.col("id").alias("query_id"), F.col("dataset").alias("name"), "language")
    return lookup_join(
        catalog, wanted, ["name", "language"], ["md5"], broadcast_bytes=broadcast_bytes
    )


def queries_without_shards(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Queries that cannot be published: their dataset has no shard in their language."""
    present = catalog.select(F.col("name").alias("dataset"), "language").distinct()
    return queries.join(present, ["dataset", "language"], "left_anti").select(*queries.columns)


def number_catalog(catalog: DataFrame) -> DataFrame:
    """Add `seq`, a shard's place within its dataset and language by md5."""
    return number_rows(catalog, ["name", "language"], ["md5"])


def batch_number(queries: DataFrame, catalog: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Fan out, with `batch_no` and the place `pos` within the batch.

    All queries of one dataset and language slice the same list of shards, so
    the catalogue is numbered, once, and not the much larger fan-out.
    """
    return with_batches(fan_out(queries, number_catalog(catalog)), batch_size)


def with_batches(jobs: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add batch_no and pos to rows numbered by `seq`."""
    return jobs.withColumns({
        "batch_no": F.expr(f"seq div {int(batch_size)}"),
        "pos": (F.col("seq") % batch_size).cast("int"),
    })


def job_contexts(jobs: DataFrame) -> DataFrame:
    """Add the `context` the classifier gets for each job."""
    return jobs.withColumn(
        "context",
        wire_struct(
            CONTEXT, data_url=object_key(), batch_size=F.lit(0), bytesize=F.col("byte_size"),
            checksum_md5=F.col("md5"), classifier_id=F.col("query_id"),
        ),
    )


def batch_requests(jobs: DataFrame) -> DataFrame:
    """One row per batch: query_id, batch_no and `data`, its contexts in order.

    A group is one batch, so a list never exceeds the batch size.
    """
    placed = F.sort_array(F.collect_list(F.struct("pos", "context")))
    return (
        job_contexts(jobs)
        .groupBy("query_id", "batch_no")
        .agg(placed.alias("_placed"))
        .select("query_id", "batch_no", F.col("_placed.context").alias("data"))
    )


def write_batches(requests: DataFrame, path: str) -> None:
    """Write requests as JSON lines: the message as `request`, and the keys acks refer to."""
    requests.select("query_id", "batch_no", F.struct("data").alias("request")).write.json(path)


def empty_acks(acks: DataFrame) -> DataFrame:
    """Acks without any job id; their batch was not accepted."""
    return acks.where(F.coalesce(F.size("ids"), F.lit(0)) <= 0)


def attach_job_ids(jobs: DataFrame, acks: DataFrame, as_of: Column) -> DataFrame:
    """Pair contexts with the ids of their batch by place; the shorter side wins.

    Returns pending jobs. Every place is a join key, so no batch or query is a hot spot.
    """
    ids = acks.select("query_id", "batch_no", F.posexplode("ids").alias("pos", "job_id"))
    return jobs.join(ids, ["query_id", "batch_no", "pos"]).select(
        "query_id", F.col("md5").alias("data_id"), "job_id", "seq",
        F.lit(PENDING).alias("status"), as_of.alias("created_at"),
    )


def pending_jobs(rows: DataFrame, as_of: Column) -> DataFrame:
    """Job rows for (query_id, data_id, job_id) given by a caller."""
    return rows.select(
        "query_id", "data_id", "job_id", F.lit(PENDING).alias("status"), as_of.alias("created_at")
    )

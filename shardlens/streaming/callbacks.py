"""Callbacks as a stream: each job's last outcome, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shardlens.operators.lookup import known_keys
from shardlens.operators.results import apply_outcomes, arrival_order
from shardlens.functions.outcomes import outcome
from shardlens.sources.callbacks import check_messages, stream_callbacks
from shardlens.streaming.changes import fold_changes, read_changes, write_batch

STORED_OUTCOMES = (
    "job_id string, outcome struct<matches:array<struct<uri:string,text:string>>,"
    "error:struct<code:int,message:string>,status:string,finished_at:timestamp,has_payload:boolean>,"
    "at struct<received_at:timestamp,content:string>"
)


def callback_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reduce arriving callbacks to one outcome per job and micro-batch, and store that.

    Arrivals may come in any order, however late: each stored outcome carries
    its place in the order of arrivals, and readers take a job's last one. A
    micro-batch reads neither jobs nor earlier batches. Messages that are no
    valid callbacks go to `<out>-rejected` in the same pass, with reasons.
    `trigger` are arguments of the stream's trigger; by default it ends when all files are taken.
    """

    def save(decoded: DataFrame, batch_id: int) -> None:
        batch = decoded.persist()  # read twice
        ok, rejected = check_messages(batch)
        write_batch(_last(ok.select("job_id", outcome(F.col("received_at")).alias("outcome"), arrival_order().alias("at"))), out, batch_id)
        write_batch(rejected, f"{out}-rejected", batch_id)
        batch.unpersist()

    return (
        stream_callbacks(spark, path, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(save)
        .start()
    )


def _last(outcomes: DataFrame) -> DataFrame:
    """The last outcome of each job, with its place."""
    last = F.max_by(F.struct("outcome", "at"), "at").alias("_last")
    return outcomes.groupBy("job_id").agg(last).select("job_id", "_last.outcome", "_last.at")


def stored_outcomes(spark: SparkSession, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """(job_id, outcome) of all jobs that callbacks named, known or not."""
    return _last(read_changes(spark, out, STORED_OUTCOMES, base, after)).select("job_id", "outcome")


def fold_outcomes(
    spark: SparkSession, out: str, target: str, upto: int, base: str | None = None, after: int = -1
) -> None:
    """Fold the batches up to `upto` into one table with a row for each job."""
    fold_changes(
        spark, out, STORED_OUTCOMES, lambda rows: _last(rows).withColumn("batch_id", F.lit(upto).cast("bigint")),
        target, upto, base, after,
    )


def unknown_outcomes(jobs: DataFrame, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """Streamed outcomes that name no job."""
    found = stored_outcomes(jobs.sparkSession, out, base, after)
    return found.join(known_keys(found.select("job_id"), jobs), "job_id", "left_anti")


def rejected_messages(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, corrupt, reasons, batch_id) of all messages that were set aside."""
    return read_changes(spark, f"{out}-rejected", "job_id string, corrupt string, reasons array<string>")


def jobs_with_stream(jobs: DataFrame, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """Jobs with the streamed outcomes; written out, it is the next snapshot of the jobs."""
    return apply_outcomes(jobs, stored_outcomes(jobs.sparkSession, out, base, after))

"""Jobs that wait too long: a deadline for each job, kept with its last outcome as state of a stream."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from shardlens.functions.outcomes import outcome
from shardlens.sources.callbacks import check_messages, stream_callbacks
from shardlens.streaming.changes import fold_changes, read_changes, write_batch

OVERDUE = "overdue"
_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOBS = "job_id string, created_at timestamp"
# A row is a job with its deadline, or a callback with its time and status (times in milliseconds and microseconds).
_EVENT = "job_id string, deadline bigint, at bigint, status string"
_CHANGE = "job_id string, status string, deadline timestamp, finished_at timestamp"


class Waiting(StatefulProcessor):
    """Keeps a job's deadline and last callback. Speaks when a callback changes the last one, and when the deadline passes without any."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Settled jobs and callbacks without a job are forgotten after a while; waiting ones have their timer.
        self.job = handle.getValueState("job", "deadline bigint, at bigint, status string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.job.get()
        deadline, at, status = old if old is not None else (None, None, None)
        last = (at, status)
        for row in rows:
            if row.deadline is not None:
                # A job that is named twice keeps its first deadline.
                deadline = row.deadline if deadline is None else min(deadline, row.deadline)
            elif last[0] is None or (row.at, row.status) > last:
                last = (row.at, row.status)
        before = old[0] if old is not None else None
        if at is None and before is not None and (before != deadline or last[0] is not None):
            self.handle.deleteTimer(before)
        if last[0] is None and deadline is not None and before != deadline:
            self.handle.registerTimer(deadline)
        self.job.update((deadline, *last))
        if last[0] is not None and (last != (at, status) or before != deadline):
            yield _change(key[0], last[1], deadline, last[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.job.get()
        if job is None or job[1] is None:
            yield _change(key[0], OVERDUE, expiredTimerInfo.getExpiryTimeInMs(), None)

    def close(self) -> None:
        pass


def _change(job_id: str, status: str, deadline_ms: int | None, at_micros: int | None) -> Row:
    deadline = None if deadline_ms is None else pd.Timestamp(deadline_ms, unit="ms", tz="UTC").to_pydatetime()
    at = None if at_micros is None else pd.Timestamp(at_micros, unit="us", tz="UTC").to_pydatetime()
    return Row(job_id=job_id, status=status, deadline=deadline, finished_at=at)


def _last_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Callbacks are reduced where they lie, so that a job with very many sends few to the task of its state."""
    for frame in frames:
        yield frame.sort_values(["at", "status"]).drop_duplicates("job_id", keep="last")


def deadline_stream(
    spark: SparkSession, jobs_path: str, callbacks_path: str, out: str, checkpoint: str,
    wait: timedelta, keep: timedelta = timedelta(days=30), files_per_batch: int = 1000,
    trigger: dict | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Watch jobs (parquet files with job_id and created_at) and callbacks, and store what becomes of each job.

    A job is overdue once `wait` has gone by since its creation and no callback has come; a
    callback that comes later settles it all the same, and the last callback counts,
    by time and status. Jobs and callbacks may come in any order and again. Jobs without an id or a time
    and messages that are no valid callbacks are left to the checks of their own feeds.
    State is in RocksDB, without payloads, and forgotten `keep` after a job's last change.
    Deadlines go by the clock of the cluster. `trigger` are arguments of the stream's trigger; by
    default it runs on, as deadlines pass without any arrival, too. State is cut into `partitions`, by default
    one for each core; the first start of a checkpoint fixes their number.
    """
    if keep <= wait:
        raise ValueError("state must be kept for longer than a job may wait")
    jobs = spark.readStream.schema(_JOBS).option("maxFilesPerTrigger", files_per_batch).parquet(jobs_path)
    waiting = jobs.where("job_id IS NOT NULL AND created_at IS NOT NULL").select(
        "job_id", (F.unix_millis("created_at") + F.lit(int(wait.total_seconds() * 1000))).alias("deadline"),
        F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("status"),
    )
    ok, _ = check_messages(stream_callbacks(spark, callbacks_path, files_per_batch))
    settled = ok.where("received_at IS NOT NULL").select(
        "job_id", F.lit(None).cast("bigint").alias("deadline"), F.unix_micros("received_at").alias("at"),
        outcome(F.col("received_at"))["status"].alias("status"),
    ).mapInPandas(_last_of_batch, _EVENT)
    changes = waiting.unionByName(settled).groupBy("job_id").transformWithState(
        Waiting(int(keep.total_seconds() * 1000)), _CHANGE, "Update", "ProcessingTime"
    )

    def save(rows: DataFrame, batch_id: int) -> None:
        changed = rows.persist()  # asked for more than once; a second run would meet a changed state
        if not changed.isEmpty():
            write_batch(changed, out, batch_id)
        changed.unpersist()

    # The stream takes the settings of its start; the session gets its own back.
    wanted = {_PROVIDER: _ROCKSDB, _PARTITIONS: str(partitions or spark.sparkContext.defaultParallelism)}
    old = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return (
            changes.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
            .trigger(**(trigger or {"processingTime": "1 minute"}))
            .foreachBatch(save).start()
        )
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_until_idle(query: StreamingQuery, batches: int = 2) -> None:
    """Wait until the stream has read nothing for `batches` batches, and stop it. Raises what it raised."""
    quiet_from = None
    while query.isActive:
        last = query.lastProgress
        if last is not None and last["numInputRows"]:
            quiet_from = None
        elif last is not None:
            quiet_from = last["batchId"] if quiet_from is None else quiet_from
            if last["batchId"] >= quiet_from + batches - 1:
                query.stop()
        time.sleep(0.1)
    query.awaitTermination()


def _last(changes: DataFrame) -> DataFrame:
    """What each job has come to. Any callback beats being overdue, and the last callback beats earlier ones."""
    now = F.max_by(F.struct("status", "finished_at"), F.struct("finished_at", "status"))
    return changes.groupBy("job_id").agg(now.alias("_now"), F.min("deadline").alias("deadline")).select(
        "job_id", "_now.status", "deadline", "_now.finished_at"
    )


def job_deadlines(spark: SparkSession, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """(job_id, status, deadline, finished_at) of all jobs that are overdue or have a callback.

    `deadline` is NULL for callbacks whose job has not come.
    """
    return _last(read_changes(spark, out, _CHANGE, base, after))


def overdue_jobs(spark: SparkSession, out: str, base: str | None = None, after: int = -1) -> DataFrame:
    """(job_id, deadline) of the jobs whose deadline went by and that still have no callback."""
    return job_deadlines(spark, out, base, after).where(F.col("status") == OVERDUE).select("job_id", "deadline")


def fold_deadlines(
    spark: SparkSession, out: str, target: str, upto: int, base: str | None = None, after: int = -1
) -> None:
    """Fold the batches up to `upto` into one table with a row for each job."""
    fold_changes(
        spark, out, _CHANGE, lambda rows: _last(rows).withColumn("batch_id", F.lit(upto).cast("bigint")),
        target, upto, base, after,
    )

"""Deadlines of jobs kept as state: order of arrival, restarts, late callbacks, waiting jobs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shardlens.streaming import deadlines

LONG_AGO, NOW = datetime(2024, 1, 1), datetime.now()


@pytest.fixture
def run(spark, tmp_path):
    def start():
        deadlines.run_until_idle(deadlines.deadline_stream(
            spark, f"{tmp_path}/jobs", f"{tmp_path}/calls", f"{tmp_path}/out", f"{tmp_path}/checkpoint",
            timedelta(days=1), keep=timedelta(days=5), files_per_batch=1, trigger={"processingTime": "0 seconds"},
            partitions=2,
        ))
        return {r.job_id: (r.status, r.deadline, r.finished_at) for r in deadlines.job_deadlines(spark, f"{tmp_path}/out").collect()}

    return start


def add_jobs(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "job_id string, created_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/jobs")


def add_calls(spark, tmp_path, *rows):
    lines = [
        ('{"jobId":"%s","receivedAt":"%sZ"%s}' % (job, at.isoformat(), ',"errorResult":{"code":5,"message":"m"}' if bad else ""),)
        for job, at, bad in rows
    ]
    spark.createDataFrame([*lines, ("no message",)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/calls")


def test_overdue_jobs_are_set_aside_and_late_callbacks_settle_them(spark, tmp_path, run):
    due, later = LONG_AGO + timedelta(days=1), LONG_AGO + timedelta(hours=1)
    add_jobs(spark, tmp_path, ("silent", LONG_AGO), ("late", LONG_AGO), ("done", LONG_AGO), ("fresh", NOW), (None, LONG_AGO), ("timeless", None))
    add_calls(spark, tmp_path, ("done", later, False), ("early", later, True), *[("done", LONG_AGO, True)] * 50)
    first = run()
    assert first == {
        "silent": ("overdue", due, None), "late": ("overdue", due, None),
        "done": ("processed", due, later), "early": ("error", None, later),
    }
    # After a restart: a callback after the deadline, an older repeat, the job of an early callback, a job named again.
    add_calls(spark, tmp_path, ("late", due + timedelta(days=1), False), ("done", LONG_AGO, True))
    add_jobs(spark, tmp_path, ("early", LONG_AGO), ("silent", LONG_AGO), ("done", LONG_AGO + timedelta(days=2)))
    second = run()
    assert second == {
        **first, "late": ("processed", due, due + timedelta(days=1)), "early": ("error", due, later),
    }
    out = f"{tmp_path}/out"
    assert [r.job_id for r in deadlines.overdue_jobs(spark, out).collect()] == ["silent"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get(
        "spark.sql.streaming.stateStore.providerClass")
    last = spark.read.option("basePath", out).parquet(out).agg(F.max("batch_id")).first()[0]
    deadlines.fold_deadlines(spark, out, f"{tmp_path}/base", last)
    folded = deadlines.job_deadlines(spark, out, f"{tmp_path}/base", last)
    assert {r.job_id: (r.status, r.deadline, r.finished_at) for r in folded.collect()} == second


def test_state_must_outlive_the_wait(spark, tmp_path):
    with pytest.raises(ValueError, match="longer"):
        deadlines.deadline_stream(spark, "a", "b", "c", "d", timedelta(days=3), keep=timedelta(days=2))

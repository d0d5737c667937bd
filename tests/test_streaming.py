"""Streams end where the batch jobs end, also after restarts and replays."""

import json
import shutil
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shardlens.operators import ingest, results
from shardlens.sources.callbacks import read_callbacks
from shardlens.streaming.callbacks import (
    callback_stream, fold_outcomes, jobs_with_stream, rejected_messages, stored_outcomes, unknown_outcomes,
)
from shardlens.streaming.listing import fold_catalog, listing_stream, read_streamed_catalog, rejected_listings


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None


def call(job, hour, kind):
    moment = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=hour)
    body = {"jobId": job, "receivedAt": moment.isoformat()}
    if kind == "error":
        body["errorResult"] = {"code": 9, "message": f"h{hour}"}
    elif kind == "match":
        body["batchClassifyResult"] = [{"uri": f"{job}#{hour}", "text": "t"}]
    return json.dumps(body)


@pytest.fixture()
def folders(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    jobs = spark.range(200).select(
        F.lit(1).cast("long").alias("query_id"),
        F.col("id").cast("string").alias("data_id"),
        F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"),
        F.lit("pending").alias("status"),
    )
    jobs.write.parquet(f"{tmp_path}/jobs")
    return tmp_path


def write_calls(folders, name, *lines):
    (folders / "calls" / f"{name}.json").write_text("\n".join(lines))


def run(spark, folders):
    finish(callback_stream(
        spark, f"{folders}/calls", f"{folders}/out", f"{folders}/checkpoint"))


def streamed(spark, folders):
    return sorted(map(str, jobs_with_stream(spark.read.parquet(f"{folders}/jobs"), f"{folders}/out").collect()))


def batch(spark, folders):
    ok, _ = read_callbacks(spark, f"{folders}/calls")
    return sorted(map(str, results.merge_callbacks(spark.read.parquet(f"{folders}/jobs"), ok).collect()))


def test_stream_equals_batch_with_late_overwrites_restart_and_replay(spark, folders):
    kinds = ["match", "error", "empty"]
    write_calls(folders, "1", *[call(f"j{i}", 10 + i % 5, kinds[i % 3]) for i in range(150)])
    # One job gets a third of all callbacks; two ids are unknown; some lines are no messages.
    write_calls(folders, "2", *[call("j7", h % 24, kinds[h % 3]) for h in range(100)],
                call("ghost", 1, "match"), call("phantom", 1, "error"), "junk", "{}")
    run(spark, folders)
    assert streamed(spark, folders) == batch(spark, folders)

    # Earlier, later and equal arrival times for jobs that already have an outcome.
    write_calls(folders, "3", *[call(f"j{i}", (5, 30, 12)[i % 3], kinds[(i + 1) % 3]) for i in range(200)])
    run(spark, folders)
    expected = batch(spark, folders)
    assert streamed(spark, folders) == expected

    unknown = unknown_outcomes(spark.read.parquet(f"{folders}/jobs"), f"{folders}/out")
    assert {r.job_id for r in unknown.collect()} == {"ghost", "phantom"}

    # Forget that the last batch was committed: it runs again and replaces itself.
    commits = sorted((folders / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for leftover in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        leftover.unlink(missing_ok=True)
    run(spark, folders)
    assert streamed(spark, folders) == expected


def test_jobs_added_between_runs_are_known(spark, folders):
    write_calls(folders, "1", call("new", 1, "match"), call("j1", 1, "match"))
    run(spark, folders)
    jobs = spark.read.parquet(f"{folders}/jobs")
    assert {r.job_id for r in unknown_outcomes(jobs, f"{folders}/out").collect()} == {"new"}
    spark.createDataFrame([(1, "n", "new", "pending")], "query_id long, data_id string, job_id string, status string").write.mode("append").parquet(f"{folders}/jobs")
    write_calls(folders, "2", call("new", 2, "match"))
    run(spark, folders)
    assert {r.job_id for r in stored_outcomes(spark, f"{folders}/out").collect()} == {"j1", "new"}


def test_bad_messages_are_stored_apart(spark, folders):
    write_calls(folders, "1", call("j1", 1, "match"), "junk", "{}", json.dumps({"jobId": "x", "errorResult": {}}))
    run(spark, folders)
    reasons = [r.reasons[0] for r in rejected_messages(spark, f"{folders}/out").collect()]
    assert sorted(reasons) == ["error code is missing", "job_id is missing", "not a callback message"]


def test_folded_batches_read_as_before(spark, folders):
    """Also when a batch after the fold holds an earlier arrival, and when folded twice."""
    out = f"{folders}/out"
    for number, hour in enumerate((9, 3, 12, 5)):
        write_calls(folders, str(number), *[call(f"j{i}", hour, "match" if i % 2 else "error") for i in range(20 * (number + 1))])
        run(spark, folders)
    whole = sorted(map(str, stored_outcomes(spark, out).collect()))
    fold_outcomes(spark, out, f"{folders}/base1", upto=1)
    assert sorted(map(str, stored_outcomes(spark, out, f"{folders}/base1", 1).collect())) == whole
    fold_outcomes(spark, out, f"{folders}/base2", upto=2, base=f"{folders}/base1", after=1)
    assert sorted(map(str, stored_outcomes(spark, out, f"{folders}/base2", 2).collect())) == whole
    jobs = spark.read.parquet(f"{folders}/jobs")
    assert sorted(map(str, jobs_with_stream(jobs, out, f"{folders}/base2", 2).collect())) == streamed(spark, folders)


def test_a_micro_batch_reads_no_other_batch(spark, folders):
    """Earlier batches may be gone or unreadable: a later one does not touch them."""
    write_calls(folders, "1", call("j1", 1, "match"))
    run(spark, folders)
    earlier = next((folders / "out").glob("batch_id=0"))
    for file in earlier.glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for crc in earlier.glob(".*.crc"):
        crc.unlink()
    write_calls(folders, "2", call("j2", 1, "match"))
    run(spark, folders)
    assert (folders / "out" / "batch_id=1").exists()


def inventory(spark, tmp_path, number, keys):
    rows = spark.createDataFrame([(k, len(k)) for k in keys], "key string, size long").coalesce(1)
    staging = tmp_path / f"staging{number}"
    rows.write.parquet(str(staging))
    (tmp_path / "inventory").mkdir(exist_ok=True)
    shutil.copy(next(Path(staging).glob("part-*.parquet")), tmp_path / "inventory" / f"{number}.parquet")


def load(spark, tmp_path):
    finish(listing_stream(
        spark, f"{tmp_path}/inventory", f"{tmp_path}/catalog", f"{tmp_path}/checkpoint", files_per_batch=1))
    return read_streamed_catalog(spark, f"{tmp_path}/catalog")


def test_streamed_catalog_has_each_shard_once_across_restarts(spark, tmp_path):
    first = [f"a/text/en/{i}.zz" for i in range(60)] + ["a/short", "a/text/far-too-long-language/q.zz"]
    second = [f"b/text/fr/{i}.zz" for i in range(40, 90)] + ["b/text/fr/50.zz/copy", "0/text/en/80.zz"]
    inventory(spark, tmp_path, 1, first)
    inventory(spark, tmp_path, 2, second)
    assert load(spark, tmp_path).count() == 90
    inventory(spark, tmp_path, 3, [f"c/text/de/{i}.zz" for i in range(80, 120)])
    streamed = load(spark, tmp_path)
    all_keys = spark.read.parquet(f"{tmp_path}/inventory")
    whole = ingest.new_catalog(ingest.catalog_rows(all_keys, F.current_timestamp()).where("length(language) <= 10"))
    assert sorted(r.md5 for r in streamed.collect()) == sorted(r.md5 for r in whole.collect())
    names = {r.md5: r["name"] for r in streamed.collect()}
    assert (names["50"], names["80"], names["90"]) == ("a", "0", "c")

    rejected = {(r.key, r.reasons[0]) for r in rejected_listings(spark, f"{tmp_path}/catalog").collect()}
    assert rejected == {
        ("a/short", "key: fewer than 4 parts"), ("a/text/far-too-long-language/q.zz", "language: too wide"),
    }
    before = sorted(map(str, streamed.drop("created_at").collect()))
    fold_catalog(spark, f"{tmp_path}/catalog", f"{tmp_path}/base", upto=1)
    folded = read_streamed_catalog(spark, f"{tmp_path}/catalog", f"{tmp_path}/base", 1)
    assert sorted(map(str, folded.drop("created_at").collect())) == before
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for leftover in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        leftover.unlink(missing_ok=True)
    again = load(spark, tmp_path)
    assert sorted(map(str, again.drop("created_at").collect())) == before

"""The last callback of a job, chosen without its payload, against a plain maximum."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shardlens.functions.outcomes import outcome
from shardlens.operators import lookup, results

CALL = "job_id string, error struct<code:int,message:string>, matches array<struct<uri:string,text:string>>, received_at {}"


def calls(spark, rows, kind="timestamp"):
    return spark.createDataFrame(rows, CALL.format(kind))


def random_calls(count, jobs, seed=7):
    """Many repeats: a third of all name one job, times collide, some are absent or before 1970."""
    rng = random.Random(seed)
    start = datetime(1969, 12, 31, 23, 59)
    rows = []
    for _ in range(count):
        job = "hot" if rng.random() < 0.34 else f"j{rng.randrange(jobs)}"
        time = None if rng.random() < 0.1 else start + timedelta(microseconds=rng.randrange(200) * 1000001)
        error = (rng.randrange(3), "e") if rng.random() < 0.3 else None
        rows.append((job, error, [(f"u{rng.randrange(4)}", "t")] * rng.randrange(3), time))
    return rows


def plain(callbacks):
    """By one maximum over whole rows."""
    best = callbacks.where("job_id IS NOT NULL").select(
        "job_id", outcome(F.col("received_at")).alias("outcome"), results.arrival_order().alias("_at")
    ).groupBy("job_id").agg(F.max_by("outcome", "_at").alias("outcome"))
    return sorted(map(str, best.collect()))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("small", [True, False])
def test_same_as_a_maximum_over_whole_rows(spark, monkeypatch, kind, small):
    if not small:
        monkeypatch.setattr(lookup.rows_with_keys, "__defaults__", (0,))
        monkeypatch.setattr(lookup.lookup_join, "__defaults__", ("inner", 0, lookup.MOST_SALTS))
    rows = calls(spark, random_calls(3000, 300) + [(None, None, [], datetime(2024, 1, 1))], kind).repartition(6).cache()
    assert sorted(map(str, results.last_outcomes(rows).collect())) == plain(rows)


def test_an_hour_that_passes_twice_keeps_its_order(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        first, second = datetime(2024, 3, 31, 2, 30, 0, 5), datetime(2024, 3, 31, 3, 10)  # 02:30 was skipped there
        rows = calls(spark, [("j", None, [("late", "t")], second), ("j", None, [("early", "t")], first)], "timestamp_ntz")
        found = results.last_outcomes(rows).select("outcome.matches.uri", "outcome.finished_at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in found] == [(["late"], second)]


def test_extreme_rows_and_times(spark):
    most = (1 << 63) - 1
    rows = [("a", -(1 << 63), 0), ("a", -(1 << 63), most), ("b", most, most), ("b", most - 1, 0), ("c", -1, 5), ("c", 0, 3)]
    found = results.last_rows(spark.createDataFrame(rows, "job_id string, _at long, _row long")).collect()
    assert sorted(tuple(r) for r in found) == [("a", -(1 << 63), most, 0), ("b", most, most, most), ("c", 0, 3, 3)]


def test_no_callback_gives_no_outcome(spark):
    assert results.last_outcomes(calls(spark, [])).count() == 0
    assert results.last_outcomes(calls(spark, [(None, None, None, None)])).count() == 0


def test_payloads_are_neither_sorted_nor_sent_to_choose(spark, monkeypatch):
    plans = {}
    exact = results.store

    def watched(frame, label):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return exact(frame, label)

    monkeypatch.setattr(results, "store", watched)
    results.last_outcomes(calls(spark, random_calls(200, 20)))
    assert "Exchange" not in plans["callbacks"]
    choice = plans["last"]
    assert "HashAggregate" in choice and "SortAggregate" not in choice and "ObjectHash" not in choice
    assert "matches" not in choice and "error" not in choice


def test_only_chosen_payloads_are_sent_on(spark):
    table = spark.range(100000).select("id", F.lit("x").alias("payload"))
    keys = spark.range(0, 100000, 1000).select("id")
    kept = lookup.rows_with_keys(table, keys, 0)
    assert kept.count() == 100 and kept.columns == table.columns
    assert lookup.with_possible(table, keys).where("_may").count() < 10000

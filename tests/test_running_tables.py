"""Statistics that follow the changes, and pages that stay, against counting and numbering anew."""

import pytest
from pyspark.sql import functions as F

from shardlens.operators import ingest, running_stats as running, stable_pages as stable
from shardlens.plans import lifecycle
from tests.test_ingest import catalog, listing, now

JOB = "query_id long, data_id string, job_id string, status string, has_payload boolean, matches string"


def counted(frame):
    return {(r.language, r.name): (r.objects, r.bytes) for r in frame.collect()}


def recount(rows):
    return counted(rows.groupBy("language", "name").agg(F.count("*").alias("objects"), F.sum("byte_size").alias("bytes")))


def test_running_stats_equal_a_recount_after_loads_deletes_and_replays(spark, tmp_path):
    out = f"{tmp_path}/changes"
    one = catalog(spark, "a/text/en/1.zz", "a/text/en/2.zz", "b/text/fr/3.zz")
    two = catalog(spark, "a/text/en/4.zz", "c/text/de/5.zz")
    assert running.running_stats(spark, out).count() == 0
    running.record_changes(out, 0, one)
    running.record_changes(out, 1, two)
    running.record_changes(out, 1, two)
    everything = one.unionByName(two)
    assert counted(running.running_stats(spark, out)) == recount(everything)
    running.fold_stats(spark, out, f"{tmp_path}/base1", 1)
    running.record_changes(out, 1, two)  # played again after it was folded
    gone = everything.where("name IN ('b', 'c') OR md5 = '2'")
    running.record_changes(out, 2, everything.where("false"), gone)
    left = everything.join(gone, "md5", "left_anti")
    assert counted(running.running_stats(spark, out, f"{tmp_path}/base1", 1)) == recount(left)
    running.fold_stats(spark, out, f"{tmp_path}/base2", 2, f"{tmp_path}/base1", 1)
    assert counted(running.running_stats(spark, out, f"{tmp_path}/base2", 2)) == recount(left)
    # A group that went and came again, and one whose objects are moved within a batch.
    running.record_changes(out, 3, gone, left.where("md5 = '1'"))
    after = left.where("md5 <> '1'").unionByName(gone)
    assert counted(running.running_stats(spark, out, f"{tmp_path}/base2", 2)) == recount(after)


def test_sizes_that_are_null_count_nothing_and_null_names_are_a_group(spark):
    rows = spark.createDataFrame(
        [("en", "text", "a", None, None), ("en", "text", "a", 3, 5), (None, "text", None, 1, 2)],
        "language string, data_type string, name string, num_of_records int, byte_size long",
    )
    found = {(r.language, r.objects, r.records, r.bytes) for r in running.signed_counts(rows).collect()}
    assert found == {("en", 2, 3, 5), (None, 1, 1, 2)}
    assert running.signed_counts(rows, rows).count() == 0


def test_statistics_do_not_read_the_catalogue(spark, tmp_path):
    out = f"{tmp_path}/changes"
    known = catalog(spark, "a/text/en/1.zz")
    known.write.parquet(f"{tmp_path}/catalog-table")
    stats = ingest.dataset_stats(known, now())
    loads = spark.createDataFrame([("a", "text")], "name string, data_type string")
    running.record_changes(out, 0, known)
    lifecycle.refresh_catalog(
        listing(spark, "a/text/en/1.zz", "a/text/en/2.zz", "a/text/fr/3.zz", "a/x"),
        spark.read.parquet(f"{tmp_path}/catalog-table"), stats, loads, now(), f"{tmp_path}/load", changes=(out, 1),
    )
    found = running.running_stats(spark, out)
    assert {(r.language, r.objects) for r in found.collect()} == {("en", 2), ("fr", 1)}
    assert not any("catalog-table" in f or "load" in f for f in found.inputFiles())


def jobs(spark, query_id, numbers, status="processed"):
    rows = [(query_id, f"d{n:05}", f"{query_id}-{n}", status, True, "m") for n in numbers]
    return spark.createDataFrame(rows, JOB)


def places(frame):
    return {r.job_id: (r.page, r.pos) for r in frame.collect()}


def test_a_later_publish_moves_no_job(spark, tmp_path):
    out = f"{tmp_path}/out"
    early = jobs(spark, 1, range(0, 50, 2)).union(jobs(spark, 2, [7])).union(jobs(spark, 3, [1], "pending"))
    stable.append_pages(early, out, 0, 10)
    before = places(stable.stable_pages(spark, out))
    late = early.union(jobs(spark, 1, range(1, 50, 2))).union(jobs(spark, 3, [0]))
    stable.append_pages(late, out, 1, 10)
    after = places(stable.stable_pages(spark, out))
    assert len(before) == 26 and before.items() <= after.items() and len(after) == 52
    nth = sorted((page - 1) * 10 + pos for job, (page, pos) in after.items() if job.startswith("1-"))
    assert nth == list(range(50)) and after["1-0"] == (1, 0) and after["1-1"] == (3, 5)
    assert after["3-0"] == (1, 0) and "3-1" not in after
    # The last batch may be played again; one without anything new adds nothing.
    stable.append_pages(late, out, 1, 10)
    stable.append_pages(late, out, 2, 10)
    assert places(stable.stable_pages(spark, out)) == after
    page = [r.job_id for r in stable.read_page(spark, out, 1, 3, 10).collect()]
    assert page == [f"1-{n}" for n in (40, 42, 44, 46, 48, 1, 3, 5, 7, 9)]
    assert stable.read_page(spark, out, 1, 6, 10).count() == 0
    assert stable.read_page(spark, out, 9, 1, 10).columns == stable.stable_pages(spark, out).columns
    with pytest.raises(ValueError):
        stable.read_page(spark, out, 1, 0, 10)


def test_nothing_visible_gives_no_page(spark, tmp_path):
    out = f"{tmp_path}/out"
    stable.append_pages(jobs(spark, 1, [1], "pending"), out, 0)
    assert stable.stable_pages(spark, out).count() == 0 and stable.read_page(spark, out, 1, 1).count() == 0
    stable.append_pages(jobs(spark, 1, [1]), out, 1)
    assert places(stable.stable_pages(spark, out)) == {"1-1": (1, 0)}


def test_a_deep_page_opens_one_file(spark, tmp_path):
    out = f"{tmp_path}/out"
    # One query holds most jobs; its pages lie in several files.
    large = spark.range(40000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(1).alias("query_id"), F.format_string("d%06d", "id").alias("data_id"),
        F.col("id").cast("string").alias("job_id"), F.lit("processed").alias("status"), F.lit(True).alias("has_payload"),
        F.lit("m").alias("matches"),
    )
    # Small ranges would be put together into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stable.append_pages(large, out, 0, 50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = stable.page_index(spark, out)
    files = index.where("query_id = 1").count()
    assert files > 1 and index.agg(F.sum("jobs")).first()[0] == 40000
    opened = stable.files_of_page(spark, out, 1, 500, 50)
    assert 1 <= len(opened) <= 2 and sum(len(stable.files_of_page(spark, out, 1, p, 50)) for p in range(500, 510)) < 15
    page = stable.read_page(spark, out, 1, 500, 50)
    assert len(page.inputFiles()) == len(opened)
    expected = large.where("query_id = 1").orderBy("data_id").offset(499 * 50).limit(50)
    assert [r.job_id for r in page.collect()] == [r.job_id for r in expected.collect()]

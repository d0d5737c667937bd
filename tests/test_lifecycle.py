"""The flows end to end, durable tables, and plans that must stay as they are."""

import uuid

import pytest
from pyspark.sql import functions as F

from shardlens.durable import durable_folder, store
from shardlens.fixtures import Inputs, as_of
from shardlens.operators import ingest, publish, results, status
from shardlens.plans import lifecycle
from tests.conftest import TESTDATA

SMALL = str(TESTDATA / "sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_load_publish_settle(spark, tmp_path):
    inputs = Inputs(spark, SMALL)
    stats = inputs.old_stats()
    catalog, stats = lifecycle.refresh_catalog(
        inputs.listing(), inputs.known_catalog(), stats, inputs.loads(), as_of(), f"{tmp_path}/load"
    )
    assert catalog.count() == 189
    assert stats.where("name = 'src0' AND language = 'en'").count() == 1

    queries = inputs.queries()
    sent = lifecycle.publish_queries(queries, catalog, f"{tmp_path}/publish", batch_size=7)
    acks = inputs.acks(sent.contexts)
    queries, jobs = lifecycle.accept_acks(queries, None, sent.contexts, acks, as_of(), f"{tmp_path}/acks")
    created = jobs.count()
    repeated = lifecycle.accept_acks(queries, jobs, sent.contexts, acks, as_of(), f"{tmp_path}/again")[1]
    assert sorted(map(str, repeated.collect())) == sorted(map(str, jobs.collect()))
    assert 0 < created < sent.contexts.count()
    assert sent.without_shards.count() == 42

    callbacks = inputs.callbacks()
    merged, pages = lifecycle.settle_jobs(jobs, callbacks, f"{tmp_path}/settle", page_size=5)
    assert merged.count() == created
    shown = merged.where("status = 'processed' AND matches IS NOT NULL").count()
    assert pages.count() == shown > 0
    counted = status.query_counters(queries, sent.contexts, merged, callbacks).agg(
        F.sum("published"), F.sum("jobs_created"), F.sum("jobs_finished")
    ).first()
    finished = merged.where("status <> 'pending'").count()
    assert tuple(counted) == (sent.contexts.count(), created, finished)

    query = queries.where("status = 'published'").join(pages.withColumnRenamed("query_id", "id"), "id", "left_semi").first()
    rows, summary = lifecycle.owner_page(queries, merged, pages, query.owner, query.id, 1, 5)
    assert 0 < rows.count() <= 5 and summary.first().total == merged.where(F.col("query_id") == query.id).count()
    for rows in lifecycle.owner_page(queries, merged, pages, "somebody", query.id, 1, 5):
        assert rows.count() == 0
    unknown = spark.read.parquet(f"{tmp_path}/settle/unknown_callbacks")
    assert unknown.join(merged, "job_id", "left_semi").count() == 0


def test_stored_tables_live_in_the_named_folder(spark, tmp_path):
    assert durable_folder(spark) == durable_folder(spark)
    stored = store(spark.range(3).withColumn("label", F.lit(uuid.uuid4().hex)), "three")
    assert stored.count() == 3
    assert stored.inputFiles()[0].startswith("file:")


def test_named_folder_comes_first_and_clusters_need_one():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.value

    class Session:
        sparkContext = Context()

    session = Session()
    session.conf = Conf("hdfs:///shared")
    assert durable_folder(session) == "hdfs:///shared"
    session.conf = Conf(None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable_folder(session)


@pytest.fixture()
def tables(spark, tmp_path):
    """Stored queries, catalogue and jobs, as the operators would meet them."""
    inputs = Inputs(spark, SMALL)
    for name in ("queries", "catalog", "jobs"):
        getattr(inputs, name)().write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("queries", "catalog", "jobs")}


def test_fan_out_does_not_shuffle_the_catalogue(tables):
    text = plan(publish.fan_out(tables["queries"], tables["catalog"]).select("query_id", "md5"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert "ReadSchema: struct<name:string,language:string,md5:string>" in text


def test_progress_reads_jobs_once_and_only_what_it_counts(tables):
    for counted in (
        status.progress(tables["queries"], tables["jobs"]),
        status.job_rollup(tables["queries"], tables["jobs"]),
        results.page_summary(tables["jobs"]),
    ):
        text = plan(counted)
        assert text.count("FileScan") == (1 if counted.columns[1] == "total" and "page" in counted.columns else 2)
        assert "has_payload:boolean" in text and "matches" not in text and "error" not in text.replace("errors", "").replace("= error", "")


def test_page_filter_and_prefix_filter_reach_the_scan(spark, tables, tmp_path):
    results.build_pages(tables["jobs"], 5).write.parquet(f"{tmp_path}/pages")
    text = plan(spark.read.parquet(f"{tmp_path}/pages").where("query_id = 7 AND page = 3"))
    assert "EqualTo(query_id,7)" in text and "EqualTo(page,3)" in text
    Inputs(spark, SMALL).listing().write.parquet(f"{tmp_path}/listing")
    text = plan(ingest.list_prefix(spark.read.parquet(f"{tmp_path}/listing"), "src0", "text", "src0/text/en/5"))
    assert "StringStartsWith(key,src0/text)" in text and "GreaterThan(key,src0/text/en/5)" in text


def test_numbering_sorts_ranges_and_never_a_whole_group(spark, tables):
    numbered = publish.number_catalog(tables["catalog"])
    text = plan(numbered)
    assert "Window" not in text and "BroadcastHashJoin" in text


def test_no_query_has_a_cross_join_or_one_task_for_all(spark):
    from shardlens.plans.registered import QUERIES

    for name, query in QUERIES.items():
        text = plan(query(spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        if name not in ("last_key_overall", "ingest_report"):  # one-row results
            assert "SinglePartition" not in text, name

"""Outcomes, merging, pages, counters, messages."""

import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shardlens.functions.wire import to_wire
from shardlens.operators import registry, results, status
from shardlens.sources.callbacks import check_messages, decode_callbacks, read_callbacks

CALL = (
    "job_id string, error struct<code:int,message:string>, "
    "matches array<struct<uri:string,text:string>>, received_at timestamp"
)
JOB = "query_id long, data_id string, job_id string, status string"
HIT = [("u", "t")]
BAD = (500, "no")


def at(day):
    return datetime(2024, 1, day)


def calls(spark, *rows):
    return spark.createDataFrame(list(rows), CALL)


def jobs(spark, *ids):
    return spark.createDataFrame([(1, f"d{j}", j, "pending") for j in ids], JOB)


def settled(spark, *rows):
    names = list(dict.fromkeys(r[0] for r in rows))
    merged = results.merge_callbacks(jobs(spark, *names), calls(spark, *rows))
    return {r.job_id: r for r in merged.collect()}


def test_outcome_table(spark):
    got = settled(
        spark,
        ("match", None, HIT, at(1)), ("empty", None, [], at(1)), ("none", None, None, at(1)),
        ("error", BAD, [], at(1)), ("both", BAD, HIT, at(1)),
    )
    seen = {j: (r.status, bool(r.matches), r.error is not None) for j, r in got.items()}
    assert seen == {
        "match": ("processed", True, False), "empty": ("processed", False, False),
        "none": ("processed", False, False), "error": ("error", False, True),
        "both": ("error", True, False),
    }
    assert got["match"].finished_at == at(1)
    shown = results.visible_results(spark.createDataFrame(list(got.values()), spark.createDataFrame(list(got.values())).schema))
    assert [r.job_id for r in shown.collect()] == ["match"]


def test_last_callback_wins_whole(spark):
    got = settled(
        spark,
        ("a", None, [], at(3)), ("a", None, HIT, at(1)),
        ("b", BAD, [], at(2)), ("b", None, HIT, at(1)),
        ("c", None, HIT, at(9)), ("c", BAD, [], at(2)),
    )
    assert (got["a"].status, got["a"].matches, got["a"].finished_at) == ("processed", None, at(3))
    assert (got["b"].status, got["b"].matches, got["b"].error.code) == ("error", None, 500)
    assert (got["c"].status, len(got["c"].matches), got["c"].error) == ("processed", 1, None)


KINDS = {"match": (None, HIT), "empty": (None, []), "error": (BAD, []), "both": (BAD, HIT)}


@given(arrivals=st.lists(
    st.tuples(st.sampled_from("abc"), st.integers(1, 28), st.sampled_from(sorted(KINDS))),
    min_size=1, max_size=15, unique_by=lambda c: c[:2],
))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_merge_in_parts_equals_one_by_one(spark, arrivals):
    rows = [(job, *KINDS[kind], at(day)) for job, day, kind in arrivals]
    whole = results.merge_callbacks(jobs(spark, "a", "b", "c"), calls(spark, *rows))
    expected = {j: "pending" for j in "abc"}
    for job, day, kind in sorted(arrivals, key=lambda c: c[1]):
        expected[job] = "error" if kind in ("error", "both") else "processed"
    assert {r.job_id: r.status for r in whole.collect()} == expected
    in_time = sorted(rows, key=lambda r: r[3])
    merged = jobs(spark, "a", "b", "c")
    for part in (in_time[: len(rows) // 2], in_time[len(rows) // 2:]):
        merged = results.merge_callbacks(merged, calls(spark, *part))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_same_time_is_settled_by_content_in_any_order(spark):
    rows = [("a", None, [("u", str(i))], at(1)) for i in range(20)]
    first, second = settled(spark, *rows), settled(spark, *reversed(rows))
    assert first["a"].matches == second["a"].matches


def test_merge_twice_is_merge_once_and_untouched_jobs_keep_their_outcome(spark):
    before = results.merge_callbacks(jobs(spark, "a", "b"), calls(spark, ("a", None, HIT, at(1))))
    later = calls(spark, ("b", BAD, [], at(2)))
    once = results.merge_callbacks(before, later)
    twice = results.merge_callbacks(once, later)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.job_id: r.status for r in once.collect()} == {"a": "processed", "b": "error"}


def test_unknown_callbacks_are_set_aside(spark):
    known = jobs(spark, "a")
    arrived = calls(spark, ("a", None, [], at(1)), ("x", None, HIT, at(1)), ("x", BAD, [], at(2)))
    assert [r.job_id for r in results.unknown_callbacks(arrived, known).collect()] == ["x", "x"]
    assert [r.job_id for r in results.merge_callbacks(known, arrived).collect()] == ["a"]


def page_jobs(spark, n=2300):
    """Query 1 with `n` jobs, every third without matches; query 2 with one."""
    return spark.range(n).select(
        F.when(F.col("id") == n - 1, 2).otherwise(1).cast("long").alias("query_id"),
        F.format_string("%06d", "id").alias("data_id"),
        F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"),
        F.lit("processed").alias("status"),
        F.when(
            F.col("id") % 3 > 0,
            F.array(F.struct(F.col("id").cast("string").alias("uri"), F.lit("t").alias("text"))),
        ).alias("matches"),
        F.lit(None).cast("struct<code:int,message:string>").alias("error"),
    )


def test_pages_in_order_are_the_visible_jobs(spark):
    source = page_jobs(spark)
    pages = results.build_pages(source, 100).where("query_id = 1").orderBy("page", "pos").collect()
    expected = [r.job_id for r in results.visible_results(source).where("query_id = 1").orderBy("data_id").collect()]
    assert [r.job_id for r in pages] == expected
    assert {r.page for r in pages} == set(range(1, 1 + -(-len(expected) // 100)))
    one = results.results_page(source, 1, 3, 100).collect()
    assert [r.job_id for r in one] == expected[200:300]
    assert results.results_page(source, 1, 99, 100).count() == 0


def test_summary_counts_all_jobs_and_shown_ones_apart(spark):
    rows = results.page_summary(page_jobs(spark), 1000).where("query_id = 1").orderBy("page").collect()
    assert [(r.page, r.total, r.visible_total, r.has_more) for r in rows] == [
        (1, 2299, 1532, True), (2, 2299, 1532, True), (3, 2299, 1532, False),
    ]


def test_page_messages(spark):
    source = page_jobs(spark, 7)
    messages = results.page_messages(results.build_pages(source, 3), results.page_summary(source, 3)).cache()
    bodies = {at: json.loads(results.page_message(messages, *at)) for at in ((1, 1), (1, 2), (2, 1))}
    assert messages.count() == 7 and results.page_message(messages, 2, 2) is None
    assert bodies[1, 1] == {
        "results": [{"results": [{"uri": str(i), "text": "t"}]} for i in (1, 2, 4)],
        "total": 6, "page": 1, "pageSize": 3, "has_more": True,
    }
    assert [len(bodies[1, p]["results"]) for p in (1, 2)] == [3, 1]
    assert bodies[2, 1]["results"] == []


def test_wire_names_and_nulls(spark):
    rows = spark.createDataFrame([(1, "d", None, "t", [])], "query_id long, dataset string, language string, query_text string, tags array<string>")
    assert json.loads(to_wire(rows).first().body) == {"queryId": 1, "dataset": "d", "queryText": "t", "tags": []}


def test_matches_one_by_one(spark):
    rows = results.explode_matches(page_jobs(spark, 6)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "j1", "1", "t"), (1, "j2", "2", "t"), (1, "j4", "4", "t"), (2, "j5", "5", "t")]


def test_counters_tell_repeats_and_short_acks(spark):
    known = spark.createDataFrame([(1,), (2,)], "id long")
    contexts = spark.createDataFrame([(1, i) for i in range(4)], "query_id long, pos int")
    arrived = calls(spark, ("a", None, [], at(1)), ("a", None, [], at(2)), ("b", BAD, [], at(1)), ("x", None, [], at(1)))
    rows = status.query_counters(known, contexts, jobs(spark, "a", "b", "c"), arrived).orderBy("query_id").collect()
    assert [tuple(r) for r in rows] == [(1, 4, 3, 3, 2), (2, 0, 0, 0, 0)]


def message(**fields):
    return json.dumps(fields)


@pytest.fixture()
def feed(spark, tmp_path):
    lines = [
        message(jobId="a", batchClassifyResult=[{"uri": "u", "text": "t"}], receivedAt="2024-01-01T00:00:00Z"),
        message(job_id="b", error_result={"code": 7}),
        message(jobId="c"),
        message(jobId="d", errorResult={"message": "no code"}),
        message(jobId="e", batchClassifyResult=[{"uri": "u"}]),
        message(errorResult={"code": 1}),
        message(jobId="f", errorResult={"code": "many"}),
        "",
        "not json",
    ]
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "1.json").write_text("\n".join(lines))
    return str(tmp_path / "calls")


def test_messages_are_read_by_either_name_and_checked(spark, feed):
    ok, rejected = read_callbacks(spark, feed)
    rows = {r.job_id: r for r in ok.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].received_at == at(1) and rows["a"].matches[0].uri == "u"
    assert rows["b"].error.code == 7 and rows["b"].error.message is None and rows["b"].matches == []
    assert rows["c"].received_at is not None
    reasons = sorted(r.reasons[0] for r in rejected.collect())
    assert reasons == [
        "error code is missing", "job_id is missing", "not a callback message", "not a callback message",
        "not a callback message", "uri or text of a match is missing",
    ]


def test_decoding_without_arrival_time_leaves_it_open(spark):
    lines = spark.createDataFrame([(message(jobId="a"),)], "value string")
    ok, _ = check_messages(decode_callbacks(lines))
    assert ok.first().received_at is None


# The flagship on queries numbered 1.. by dataset and language, with the counts
# that were taken from the tables beforehand: queries, jobs, visible, errors.
@pytest.mark.parametrize("scale, expected", [
    ("sf0.001", (30, 92, 32, 5)), ("sf0.01", (40, 693, 206, 40)), ("sf0.1", (40, 6974, 2116, 313)),
])
def test_progress_totals(spark, scale, expected):
    from shardlens.fixtures import Inputs
    from tests.conftest import TESTDATA

    class Numbered(Inputs):
        def queries(self):
            return self.spark.sql(f"""
                SELECT CAST(id AS BIGINT) AS id, dataset, language, 'u' AS owner,
                       CASE id % 4 WHEN 0 THEN 'pending' WHEN 3 THEN NULL ELSE 'published' END AS status
                FROM (SELECT row_number() OVER (ORDER BY source, lang) AS id, source AS dataset, lang AS language
                      FROM (SELECT DISTINCT source, lang FROM parquet.`{self.folder}/documents.parquet`))""")

    inputs = Numbered(spark, str(TESTDATA / scale))
    rows = status.progress(inputs.queries(), inputs.jobs())
    got = rows.agg(F.count("*"), F.sum("total"), F.sum("visible"), F.sum("errors")).first()
    assert tuple(got) == expected


def test_status_of_a_query_without_anything(spark):
    known = spark.createDataFrame([(1, "a", "en", at(1))], "id long, dataset string, language string, created_at timestamp")
    shards = spark.createDataFrame([("a", "en"), ("a", "en")], "name string, language string")
    row = status.query_status(known, shards, jobs(spark, "x").where("false")).first()
    assert (row.dataset_size, row.query_results_count, row.processed_records) == (2, 0, 0)
    assert registry.queries_with_jobs(known, jobs(spark, "x")).count() == 1

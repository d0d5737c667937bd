"""Fan-out, numbering, batches, acks, registration."""

import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shardlens.fixtures import Inputs, as_of
from shardlens.operators import lookup, publish, registry
from shardlens.operators.constraints import check_constraints, check_page, orphan_jobs, unique_violations
from shardlens.operators.keyed import delete_queries
from shardlens.operators.numbering import number_rows
from shardlens.sources.requests import decode_acks, decode_requests
from tests.conftest import TESTDATA

SHARD = "name string, language string, data_type string, md5 string, byte_size long, decompressed_byte_size long"
QUERY = "id long, dataset string, language string, query_text string, model string, owner string, status string"


def shards(spark, *rows):
    return spark.createDataFrame([(n, l, t, m, 10, 0) for n, l, t, m in rows], SHARD)


def queries(spark, *rows):
    return spark.createDataFrame([(i, d, l, f"t{i}", "m", "u", s) for i, d, l, s in rows], QUERY)


@pytest.fixture()
def skewed(spark):
    """Over two thirds of all shards in one dataset and language, with ids that share a prefix."""
    return spark.range(30000).select(
        F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))).alias("name"),
        F.lit("en").alias("language"),
        F.lit("text").alias("data_type"),
        F.concat(F.lit("aaaa"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("md5"),
        F.lit(10).cast("long").alias("byte_size"),
        F.lit(0).cast("long").alias("decompressed_byte_size"),
    )


def test_data_type_plays_no_part_and_null_language_matches_nothing(spark):
    catalog = shards(spark, ("a", "en", "text", "1"), ("a", "en", "html", "2"), ("a", "fr", "text", "3"))
    wanted = queries(spark, (1, "a", "en", "pending"), (2, "a", None, "pending"), (3, "b", "en", "pending"))
    assert {(r.query_id, r.md5) for r in publish.fan_out(wanted, catalog).collect()} == {(1, "1"), (1, "2")}
    assert {r.id for r in publish.queries_without_shards(wanted, catalog).collect()} == {2, 3}


def test_fan_out_is_the_same_broadcast_and_salted(spark, skewed):
    wanted = queries(spark, (1, "big", "en", None), (2, "d1", "en", None), (3, "big", "en", None), (4, "x", "en", None))
    columns = ["query_id", "name", "md5"]
    small = publish.fan_out(wanted, skewed).select(columns)
    salted = publish.fan_out(wanted, skewed, broadcast_bytes=0).select(columns)
    assert small.count() == salted.count() > 40000
    assert small.exceptAll(salted).count() == 0
    assert "_salt" in salted._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), "id")
    control = spark.createDataFrame([(0, "a"), (3, "b"), (3, "c"), (9, "d"), (None, "e")], "k long, v string")
    plain = rows.join(control, ["k"], how)
    salted = lookup.lookup_join(rows, control, ["k"], ["id"], how, broadcast_bytes=0, salts=5)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_only_hot_keys_are_salted(spark):
    """A key with a third of the rows is spread, its control rows are repeated, and all others stay single."""
    third = F.col("id") % 3 == 0
    rows = spark.range(60_000).select(F.when(third, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    control = spark.range(-1, 60_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    hot = lookup.hot_keys(rows, ["k"])
    even = 60_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(hot) == 0 or even * lookup.HOT < 20_000  # eight partitions make no key hot
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1024"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = lookup.hot_keys(rows, ["k"])
        (number, salts), = hot
        assert number == rows.where("k = -1").select(F.xxhash64("k")).first()[0] and 14 <= salts <= 20
        joined = lookup.lookup_join(rows, control, ["k"], ["id"], broadcast_bytes=0)
        tasks = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[1] == 60_000 and tasks[0] < 6 * 60_000 / 50
        assert joined.select("k", "id", "v").exceptAll(rows.join(control, "k").select("k", "id", "v")).isEmpty()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for key in settings:
            spark.conf.unset(key)


def test_hot_keys_of_few_rows(spark):
    assert lookup.hot_keys(spark.range(0), ["id"]) == []
    rows = spark.createDataFrame([(None, 1)] * 5, "k long, v long")
    assert [s for _, s in lookup.hot_keys(rows, ["k"], salts=3)] in ([], [3])
    assert lookup.lookup_join(rows, rows.limit(0), ["k"], ["v"], "left", broadcast_bytes=-1).count() == 5


def test_a_salted_control_table_cannot_keep_its_own_rows(spark):
    with pytest.raises(ValueError):
        lookup.lookup_join(spark.range(1), spark.range(1), ["id"], ["id"], "full")


@pytest.fixture()
def many_partitions(spark):
    """Small sorts would be put together into one partition otherwise."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_numbers_are_exact_in_a_group_spread_over_partitions(spark, skewed, many_partitions):
    numbered = number_rows(skewed.select("name", "md5"), ["name"], ["md5"])
    assert len([f for f in numbered.inputFiles() if "numbered" in f]) >= 6
    wrong = numbered.withColumn(
        "true_seq", F.expr("row_number() OVER (PARTITION BY name ORDER BY md5) - 1")
    ).where("seq <> true_seq")
    assert wrong.count() == 0 and numbered.count() == 30000


def test_numbers_over_all_rows_and_with_null_groups(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9)], "g string, v int")
    assert sorted((r.v, r.seq) for r in number_rows(rows, [], ["v"]).collect()) == [(1, 0), (2, 1), (3, 2), (9, 3)]
    assert {(r.g, r.v, r.seq) for r in number_rows(rows, ["g"], ["v"]).collect()} == {
        (None, 1, 0), (None, 3, 1), ("a", 2, 0), ("a", 9, 1),
    }


def test_batches_hold_every_shard_once_and_only_the_last_is_short(spark, skewed):
    wanted = queries(spark, (1, "big", "en", None), (2, "d0", "en", None))
    rows = publish.batch_number(wanted, skewed, 1000).select("query_id", "batch_no", "pos", "md5").collect()
    assert len(rows) == len({(r.query_id, r.md5) for r in rows}) == len({(r.query_id, r.batch_no, r.pos) for r in rows})
    for query_id, total in ((1, 21000), (2, 3000)):
        sizes = Counter(r.batch_no for r in rows if r.query_id == query_id)
        assert sum(sizes.values()) == total
        assert [sizes[b] for b in range(len(sizes) - 1)] == [1000] * (len(sizes) - 1)
        mine = sorted((r.batch_no, r.pos, r.md5) for r in rows if r.query_id == query_id)
        assert [m for _, _, m in mine] == sorted(m for _, _, m in mine)


@given(
    rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 10**6)), min_size=1, max_size=60, unique=True),
    size=st.integers(1, 9),
)
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_batches_partition_any_groups(spark, many_partitions, rows, size):
    numbered = number_rows(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"])
    got = {}
    for r in publish.with_batches(numbered, size).collect():
        got.setdefault(r.g, []).append((r.batch_no, r.pos, r.v))
    for g in {g for g, _ in rows}:
        values = sorted(v for other, v in rows if other == g)
        assert sorted(got[g]) == [(i // size, i % size, v) for i, v in enumerate(values)]


def test_whole_corpus_in_batches_of_a_thousand(spark):
    corpus = Inputs(spark, str(TESTDATA / "sf0.1")).catalog().withColumns(
        {"name": F.lit("all"), "language": F.lit("any")}
    )
    batches = publish.batch_number(queries(spark, (1, "all", "any", None)), corpus)
    sizes = {r["batch_no"]: r["count"] for r in batches.groupBy("batch_no").count().collect()}
    assert sizes == {**{b: 1000 for b in range(9)}, 9: 296}


def test_requests_as_json(spark, tmp_path):
    catalog = shards(spark, ("a", "en", "text", "2"), ("a", "en", "text", "1"), ("a", "en", "text", "3"))
    batches = publish.batch_number(queries(spark, (5, "a", "en", None)), catalog, 2)
    publish.write_batches(publish.batch_requests(batches), f"{tmp_path}/requests")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/requests").collect()]
    by_batch = {l["batch_no"]: l["request"]["data"] for l in lines}
    assert by_batch[0][0] == {
        "dataUrl": "a/text/en/1.zz", "batchSize": 0, "bytesize": 10, "decompressedByteSize": 0,
        "checksumMd5": "1", "classifierId": 5,
    }
    assert [[c["checksumMd5"] for c in by_batch[b]] for b in (0, 1)] == [["1", "2"], ["3"]]


def test_short_and_long_acks_pair_by_place(spark):
    catalog = shards(spark, *[("a", "en", "text", str(i)) for i in range(5)])
    sent = publish.batch_number(queries(spark, (5, "a", "en", None)), catalog, 2)
    acks = spark.createDataFrame(
        [(5, 0, ["j0"]), (5, 1, ["j2", "j3", "j-extra"]), (5, 2, []), (6, 0, None)],
        "query_id long, batch_no long, ids array<string>",
    )
    jobs = publish.attach_job_ids(sent, acks, as_of())
    assert {(r.data_id, r.job_id, r.status) for r in jobs.collect()} == {
        ("0", "j0", "pending"), ("2", "j2", "pending"), ("3", "j3", "pending"),
    }
    assert {(r.query_id, r.batch_no) for r in publish.empty_acks(acks).collect()} == {(5, 2), (6, 0)}
    marked = registry.mark_published(
        queries(spark, (5, "a", "en", "pending"), (6, "a", "en", "pending"), (7, "a", "en", None)), acks
    )
    assert {r.id: r.status for r in marked.collect()} == {5: "published", 6: "pending", 7: None}


def test_registration_renames_the_owner_and_rejects_bad_rows(spark):
    requests = spark.createDataFrame(
        [(1, "a", None, "t", "m", "me"), (2, "a", "en", None, "m", "me"), (3, "a", "x" * 11, "t", "m" * 256, "me")],
        "query_id long, dataset string, language string, query_text string, model string, user string",
    )
    ok, rejected = registry.register_queries(requests, as_of())
    assert [(r.id, r.owner, r.status) for r in ok.collect()] == [(1, "me", "pending")]
    assert {r.id: r.reasons for r in rejected.collect()} == {
        2: ["query_text: missing"], 3: ["language: too wide", "model: too wide"],
    }


def test_requests_as_messages_get_ids_of_their_own(spark):
    def line(**fields):
        return (json.dumps(fields),)

    body = {"dataset": "a", "language": "en", "model": "m", "user": "me"}
    lines = spark.createDataFrame(
        [line(**body, queryText="one"), line(**body, query_text="two"), line(**body), ("[]x",),
         line(**{**body, "user": None}, queryText="q"), line(**body, queryText="one")],
        "value string",
    )
    ok, rejected = decode_requests(lines)
    assert sorted(r.reasons[0] for r in rejected.collect()) == [
        "not a message of this kind", "query_text is missing", "user is missing",
    ]
    numbered = registry.assign_ids(ok, queries(spark, (7, "a", "en", None)))
    registered, _ = registry.register_queries(numbered, as_of())
    assert sorted((r.id, r.query_text) for r in registered.collect()) == [(8, "one"), (9, "one"), (10, "two")]
    first = registry.assign_ids(ok, queries(spark, (7, "a", "en", None)).where("false"))
    assert sorted(r.query_id for r in first.collect()) == [1, 2, 3]


def test_acks_as_messages(spark):
    lines = spark.createDataFrame(
        [('{"query_id":1,"batch_no":0,"ids":["a","b"]}',), ('{"query_id":1,"batch_no":1,"ids":[]}',),
         ('{"query_id":1,"batch_no":2}',), ('{"ids":["c"]}',), ("?",)],
        "value string",
    )
    ok, rejected = decode_acks(lines)
    assert [tuple(r) for r in ok.collect()] == [(1, 0, ["a", "b"])]
    assert sorted(r.reasons for r in rejected.collect()) == [
        ["ids is missing"], ["ids is missing"], ["not a message of this kind"],
        ["query_id is missing", "batch_no is missing"],
    ]


def test_statuses_null_passes_and_unknown_words_do_not(spark):
    rows = queries(spark, *[(i, "a", "en", s) for i, s in enumerate(
        ["pending", "publishing", "published", "processed", None, "done"])])
    ok, rejected = check_constraints(rows, "queries")
    assert {r.id for r in ok.collect()} == {0, 1, 2, 3, 4}
    assert [(r.id, r.reasons) for r in rejected.collect()] == [(5, ["status: not allowed"])]


def test_defaults_fill_absent_columns_only(spark):
    rows = spark.createDataFrame([("a", "text", "m")], "name string, data_type string, md5 string")
    row = check_constraints(rows, "datasets")[0].first()
    assert (row.language, row.byte_size, row.source) == ("unknown", 0, "")
    given = rows.withColumn("language", F.lit(None).cast("string"))
    assert check_constraints(given, "datasets")[1].first().reasons == ["language: missing"]


def test_unique_and_foreign_keys(spark):
    jobs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (9, None), (9, None)], "query_id long, job_id string")
    assert [tuple(r) for r in unique_violations(jobs, "query_results").collect()] == [("a", 2)]
    known = queries(spark, (1, "a", "en", None), (2, "a", "en", None))
    assert {r.query_id for r in orphan_jobs(jobs, known).collect()} == {9}


def test_eligibility(spark):
    known = queries(
        spark, (1, "a", "en", "published"), (2, "a", "en", "pending"), (3, "a", "en", None), (4, "a", "en", "processed")
    )
    jobs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id long, job_id string")
    assert [r.id for r in registry.eligible_queries(known, jobs).collect()] == [1]
    assert registry.eligible_queries(known, jobs, "other").count() == 0
    assert [r.query_text for r in registry.query_context(known, 3).collect()] == ["t3"]


def test_delete_takes_jobs_along(spark):
    known = queries(spark, (1, "a", "en", None), (2, "a", "en", None))
    jobs = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "query_id long, job_id string")
    ids = spark.createDataFrame([(2,), (2,), (77,)], "query_id long")
    left, jobs_left = delete_queries(known, jobs, ids)
    assert [r.id for r in left.collect()] == [1] and [r.job_id for r in jobs_left.collect()] == ["x"]


@pytest.mark.parametrize("page", [0, -1, 1.5, "1", True, None])
def test_bad_pages(page):
    with pytest.raises(ValueError):
        check_page(page)

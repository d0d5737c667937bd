"""The classifier hook and the records it sees."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardlens.operators import results
from shardlens.operators.classify import classify
from shardlens.sources.records import explode_records, record_counts, scan_records

JOB = "job_id string, query_text string, model string, data_id string"
SHARD = "data_id string, doc_id long, text string"


def contains_query(query_text, model, part):
    if (part["text"] == "poison").any():
        raise RuntimeError("cannot read")
    return part["text"].str.contains(query_text, regex=False)


@pytest.fixture(params=[3, 10000])
def batch_rows(spark, request):
    """Arrow batches that cut jobs apart, and ones that hold many jobs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def test_matches_errors_and_empty_jobs(spark, batch_rows):
    texts = {
        "s1": "\n".join(["cat"] * 5 + ["dog"] + ["cat"] * 5),
        "s2": "dog\n\ncat dog",
        "s3": "\n".join(["cat"] * 9 + ["poison"] + ["cat"] * 9),
        "s4": "",
    }
    shards = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(texts.items())], SHARD)
    jobs = spark.createDataFrame(
        [(f"{s}-{q}", q, "m", s) for s in [*texts, "absent"] for q in ("cat", "dog", "cow")], JOB
    )
    got = {r.job_id: r for r in classify(jobs, shards, contains_query).collect()}
    assert set(got) == {f"{s}-{q}" for s in [*texts, "absent"] for q in ("cat", "dog", "cow")}
    assert tuple(got["absent-cat"].error) == (404, "shard not found") and got["absent-cat"].matches == []
    assert [m.uri for m in got["s1-cat"].matches] == [f"0#{i}" for i in range(11) if i != 5]
    assert [tuple(m) for m in got["s2-dog"].matches] == [("1#0", "dog"), ("1#2", "cat dog")]
    assert got["s1-cow"].matches == [] and got["s1-cow"].error is None
    assert got["s4-cat"].matches == [] and got["s4-cat"].error is None
    for q in ("cat", "dog", "cow"):
        assert got[f"s3-{q}"].matches == []
        assert tuple(got[f"s3-{q}"].error) == (500, "RuntimeError: cannot read")


def test_shard_without_text_is_an_error(spark):
    shards = spark.createDataFrame([("s1", 1, None), ("s2", 2, "cat")], SHARD)
    jobs = spark.createDataFrame([(f"j-{s}", "cat", "m", s) for s in ("s1", "s2", "s3")], JOB)
    big = spark.createDataFrame([("s1",), ("s3",)], "data_id string")
    for chosen in (None, big):
        got = {r.job_id: r for r in classify(jobs, shards, contains_query, big=chosen).collect()}
        assert len(got) == 3 and len(got["j-s2"].matches) == 1
        assert {got[j].error.code for j in ("j-s1", "j-s3")} == {404}


def test_callbacks_of_the_classifier_merge_into_jobs(spark):
    shards = spark.createDataFrame([("s1", 1, "cat\ndog")], SHARD)
    jobs = spark.createDataFrame([("j1", "cat", "m", "s1"), ("j2", "cow", "m", "s1")], JOB)
    found = classify(jobs, shards, contains_query).withColumn("received_at", F.current_timestamp())
    pending = jobs.select(F.lit(1).alias("query_id"), "data_id", "job_id", F.lit("pending").alias("status"))
    merged = {r.job_id: r for r in results.merge_callbacks(pending, found).collect()}
    assert [tuple(m) for m in merged["j1"].matches] == [("1#0", "cat")]
    assert (merged["j2"].status, merged["j2"].matches) == ("processed", None)


def test_a_failing_answer_is_an_error_of_the_job_only(spark):
    def answer(query_text, model, part):
        return pd.Series([True]) if model == "short" else pd.Series([None] * len(part))

    shards = spark.createDataFrame([("s1", 1, "a\nb")], SHARD)
    jobs = spark.createDataFrame([("j1", "q", "short", "s1"), ("j2", "q", "null", "s1")], JOB)
    got = {r.job_id: r for r in classify(jobs, shards, answer).collect()}
    assert got["j1"].error is not None and got["j1"].matches == []
    assert got["j2"].error is None and got["j2"].matches == []


def test_big_shards_give_the_same_answers(spark, batch_rows, monkeypatch):
    from shardlens.operators import classify as module

    monkeypatch.setattr(module, "PART_LINES", 4)
    texts = {
        "s1": "\n".join(["cat"] * 11 + ["dog"] + ["cat"] * 8), "s2": "cat", "s3": "cat\n" * 30 + "poison\n" + "cat\n" * 30,
        "s4": "\n" * 9, "s5": "dog\n" * 7,
    }
    shards = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(texts.items())], SHARD)
    jobs = spark.createDataFrame([(f"{s}-{q}", q, "m", s) for s in texts for q in ("cat", "dog")], JOB)
    sizes = shards.select("data_id", F.octet_length("text").alias("byte_size"))
    big = module.big_shards(sizes, "data_id", limit=8)
    assert {r.data_id for r in big.collect()} == {"s1", "s3", "s4", "s5"}
    plain = sorted(map(str, classify(jobs, shards, contains_query).collect()))
    assert sorted(map(str, classify(jobs, shards, contains_query, big=big).collect())) == plain
    assert len(plain) == 10


def test_one_shard_with_most_records(spark):
    shards = spark.createDataFrame([("big", 0, "\n".join(["cat"] * 200_000))] + [(f"s{i}", i, "cat\ndog") for i in range(1, 50)], SHARD)
    jobs = shards.select(F.concat(F.lit("j"), "data_id").alias("job_id"), F.lit("cat").alias("query_text"), F.lit("m").alias("model"), "data_id")
    sizes = {r.job_id: r.n for r in classify(jobs, shards, contains_query).select("job_id", F.size("matches").alias("n")).collect()}
    assert sizes.pop("jbig") == 200_000 and set(sizes.values()) == {1} and len(sizes) == 49


def test_records_keep_blank_lines_and_agree_with_counts(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, "é")], "doc_id long, text string")
    assert [r.text for r in scan_records(docs).where("uri LIKE '1#%'").collect()] == ["a", "", "b", ""]
    counts = {r.doc_id: (r.num_of_records, r.decompressed_byte_size) for r in record_counts(docs).collect()}
    assert counts == {1: (4, 5), 2: (1, 0), 3: (1, 2)}
    kept = explode_records(docs.withColumn("extra", F.lit(1)))
    assert set(kept.columns) == {"doc_id", "extra", "uri", "text"}

"""Keys, loads, insert-ignore, statistics."""

import hashlib
import uuid
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shardlens.operators import ingest
from shardlens.operators.keyed import first_per_key, upsert
from shardlens.sources.listing import cut_range, list_page, read_inventory, scan_listing
from shardlens.sources.tables import read_table, scan_catalog, write_table

LISTING = "key string, size long"


def listing(spark, *keys):
    return spark.createDataFrame([(k, len(k)) for k in keys], LISTING)


def catalog(spark, *keys, at="2024-01-01"):
    return ingest.new_catalog(
        ingest.catalog_rows(listing(spark, *keys), F.to_timestamp_ntz(F.lit(at + " 00:00:00")))
    )


def now():
    return F.to_timestamp_ntz(F.lit("2024-02-02 00:00:00"))


def test_key_is_cut_after_four_parts_and_all_suffixes_go(spark):
    rows = ingest.parse_keys(listing(spark, "a/text/en/x.zzy.zz/extra", "a//en/", "a/text/en/q.zz"))
    assert [tuple(r[2:]) for r in rows.orderBy("key").collect()] == [
        ("a", "", "en", ""), ("a", "text", "en", "q"), ("a", "text", "en", "xy"),
    ]


def test_short_keys_are_rejected(spark):
    ok, bad = ingest.split_valid(listing(spark, "a/b/c", "a/b/c/d", "", "////").union(
        spark.createDataFrame([(None, 1)], LISTING)))
    assert {r.key for r in ok.collect()} == {"a/b/c/d", "////"}
    assert {r.key for r in bad.collect()} == {"a/b/c", "", None}


def test_prefix_covers_longer_types_and_start_is_exclusive(spark):
    rows = listing(spark, "a/text/en/1.zz", "a/text2/en/2.zz", "a/html/en/3.zz", "ab/text/en/4.zz")
    found = ingest.list_prefix(rows, "a", "text", "a/text/en/1.zz")
    assert [r.key for r in found.collect()] == ["a/text2/en/2.zz"]
    loads = spark.createDataFrame(
        [("a", "text", None), ("a", "text2", ""), ("a", "h", "a/html/en/3.zz")],
        "name string, data_type string, start_after string",
    )
    found = {(r.load_type, r.key) for r in ingest.list_loads(rows, loads).collect()}
    assert found == {
        ("text", "a/text/en/1.zz"), ("text", "a/text2/en/2.zz"), ("text2", "a/text2/en/2.zz"),
    }


def test_one_shard_per_md5_smallest_key_wins_whatever_its_group(spark):
    rows = catalog(spark, "b/text/en/x.zz", "a/text/fr/x.zz", "a/text/fr/y.zz").collect()
    assert {(r.name, r.language, r.md5) for r in rows} == {("a", "fr", "x"), ("a", "fr", "y")}


def test_existing_row_wins_and_a_second_load_changes_nothing(spark):
    old = catalog(spark, "b/text/en/x.zz")
    new = ingest.catalog_rows(listing(spark, "a/text/en/x.zz", "a/text/en/z.zz"), now())
    once = ingest.add_to_catalog(old, new)
    twice = ingest.add_to_catalog(once, new)
    expected = {("b", "x"), ("a", "z")}
    assert {(r["name"], r["md5"]) for r in once.collect()} == expected
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_insert_is_the_same_with_few_and_with_many_new_rows(spark, monkeypatch):
    from shardlens.operators import lookup

    old = catalog(spark, *[f"a/text/en/{i}.zz" for i in range(50)])
    new = ingest.catalog_rows(listing(spark, *[f"c/text/en/{i}.zz" for i in range(30, 90)]), now())
    few = sorted(map(tuple, ingest.add_to_catalog(old, new).collect()))
    monkeypatch.setattr(lookup.known_keys, "__defaults__", (0,))
    assert sorted(map(tuple, ingest.add_to_catalog(old, new).collect())) == few
    assert len(few) == 90


def test_resume_goes_on_after_the_last_key_of_each_dataset(spark):
    old = catalog(spark, "a/text/en/k.zz", "b/text/en/a.zz")
    rows = listing(spark, "a/text/en/j.zz", "a/text/en/m.zz", "b/text/en/b.zz", "c/text/en/c.zz")
    loads = spark.createDataFrame([("a", "text"), ("b", "text")], "name string, data_type string")
    resumed, _ = ingest.load_dataset(rows, old, loads, now(), resume=True)
    assert {r.md5 for r in resumed.collect()} == {"k", "a", "m", "b"}
    fresh, _ = ingest.load_dataset(rows, old, loads, now())
    assert {r.md5 for r in fresh.collect()} == {"k", "a", "j", "m", "b"}


def test_last_key_overall_is_of_the_newest_row(spark):
    both = catalog(spark, "z/text/en/k.zz").union(catalog(spark, "a/text/en/b.zz", at="2024-03-01"))
    assert ingest.last_key_overall(both).first().last_key == "a/text/en/b.zz"
    assert ingest.last_key_overall(both.where("false")).first().last_key == ""


def test_rows_that_break_a_rule_are_reported_not_loaded(spark):
    rows = listing(spark, "a/text/en/ok.zz", "a/text/much-too-long/x.zz", "a/text")
    loads = spark.createDataFrame([("a", "text")], "name string, data_type string")
    empty = catalog(spark, "q/text/en/q.zz").where("false")
    loaded, rejected = ingest.load_dataset(rows, empty, loads, now())
    assert [r.md5 for r in loaded.collect()] == ["ok"]
    assert {r.key for r in rejected.collect()} == {"a/text/much-too-long/x.zz", "a/text"}
    rejects = {r.key: r.reasons for r in ingest.load_rejects(rows).collect()}
    assert rejects == {
        "a/text/much-too-long/x.zz": ["language: too wide"], "a/text": ["key: fewer than 4 parts"],
    }
    report = ingest.ingest_report(rows, empty).first()
    assert tuple(report) == (3, 2, 1, 1)


def test_report_of_an_empty_listing(spark):
    empty = listing(spark, "x").where("false")
    assert tuple(ingest.ingest_report(empty, catalog(spark, "a/text/en/b.zz")).first()) == (0, 0, 0, 0)


def test_described_records_default_to_english(spark):
    rows = spark.createDataFrame([("a", "text", "m", 5)], "name string, data_type string, md5 string, byte_size long")
    row = ingest.record_rows(rows, now()).first()
    assert (row.language, row.num_of_records, row.source) == ("en", None, None)


def test_stats_upsert_keeps_vanished_groups(spark):
    stats = ingest.dataset_stats(catalog(spark, "a/text/en/1.zz", "gone/text/en/2.zz"), now())
    later = F.to_timestamp_ntz(F.lit("2024-09-09 00:00:00"))
    renewed = ingest.update_stats(stats, catalog(spark, "a/text/en/1.zz", "a/text/en/3.zz", "b/text/fr/4.zz"), later)
    got = {(r["name"], r["total_objects"], r["created_at"].month) for r in renewed.collect()}
    assert got == {("a", 2, 9), ("b", 1, 9), ("gone", 1, 2)}


def test_upsert_matches_columns_by_name(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([("B", 2), ("C", 3)], "v string, id int")
    assert sorted(map(tuple, upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_first_per_key_with_one_key_holding_most_rows(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * -1).alias("v")
    )
    got = {r.k: r.v for r in first_per_key(rows, ["k"], [F.col("v")]).collect()}
    assert got[0] == -19999 or got[0] == -19998
    assert len(got) == 1 + len([i for i in range(20000) if i % 3 == 2])


@pytest.fixture()
def bucket(tmp_path):
    for key in ["a/text/en/1.zz", "a/text/fr/2 %41.zz", "b/stray", "_b/.c/_d.zz", "a/text/empty.zz", "x y/%20/z"]:
        file = tmp_path / "bucket" / key
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if "empty" in key else b"x" * len(key))
    return tmp_path / "bucket"


def test_listing_of_a_folder_reads_no_contents(spark, bucket):
    for root in (str(bucket), f"file://{bucket}/", Path(bucket).as_uri()):
        got = scan_listing(spark, root)
        assert {(r["key"], r["size"]) for r in got.collect()} == {
            ("a/text/en/1.zz", 14), ("a/text/fr/2 %41.zz", 18), ("b/stray", 7),
            ("_b/.c/_d.zz", 11), ("a/text/empty.zz", 0), ("x y/%20/z", 9),
        }


def test_inventory_and_stored_catalog(spark, tmp_path):
    listing(spark, "a/text/en/1.zz", "b/text/fr/2.zz").write.parquet(f"{tmp_path}/inventory")
    shards = ingest.new_catalog(ingest.catalog_rows(read_inventory(spark, f"{tmp_path}/inventory"), now()))
    write_table(shards, f"{tmp_path}/datasets", "datasets")
    assert {tuple(r) for r in read_table(spark, f"{tmp_path}/datasets").select(*shards.columns).collect()} == {
        tuple(r) for r in shards.collect()
    }
    found = scan_catalog(spark, f"{tmp_path}/datasets", "a", "en")
    assert [r.md5 for r in found.collect()] == ["1"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(name,a)" in plan
    with pytest.raises(Exception, match="already exists"):
        write_table(shards, f"{tmp_path}/datasets", "datasets")


def test_languages_come_back_as_they_were(spark, tmp_path):
    languages = ["", "007", "7", "2024-01-01", "true", None, "a=b", "é/x", "=x", " "]
    rows = spark.createDataFrame([("a", x, f"m{i}") for i, x in enumerate(languages)], "name string, language string, md5 string")
    write_table(rows, f"{tmp_path}/datasets", "datasets")
    back = read_table(spark, f"{tmp_path}/datasets")
    assert back.schema == rows.schema
    assert {r.md5: r.language for r in back.collect()} == {f"m{i}": x for i, x in enumerate(languages)}
    assert [r.md5 for r in scan_catalog(spark, f"{tmp_path}/datasets", language="007").collect()] == ["m1"]
    assert [r.md5 for r in scan_catalog(spark, f"{tmp_path}/datasets", language="").collect()] == ["m0"]


def test_empty_snapshot_reads_with_its_schema(spark, tmp_path):
    rows = spark.createDataFrame([], "name string, language string, md5 string")
    write_table(rows, f"{tmp_path}/datasets", "datasets")
    assert read_table(spark, f"{tmp_path}/datasets", rows.schema).collect() == []


def test_flat_folder_is_listed_in_pages_by_several_tasks(spark, tmp_path):
    """No call returns more than a page, and the ranges of one folder go to several tasks."""
    names = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)] + [f"2024-{i:05}" for i in range(700)]
    names += ["é", "_hidden", ".x", "zz", " blank", "a" * 200]
    (tmp_path / "b/en/deep").mkdir(parents=True)
    (tmp_path / "b/en/deep/er").write_bytes(b"1")
    for n, name in enumerate(names):
        (tmp_path / "b/en" / name).write_bytes(b"x" * (n % 5))
    calls = tmp_path / "calls"
    calls.mkdir()

    def lister(folder, after, upto, limit):
        from pyarrow import fs
        from pyspark import TaskContext

        found = list_page(fs.LocalFileSystem())(folder, after, upto, limit)
        task = TaskContext.get()
        (calls / f"{task.stageId()}-{task.partitionId()}-{uuid.uuid4()}").write_text(str(len(found)))
        return found

    got = scan_listing(spark, str(tmp_path / "b"), lister, page=100).collect()
    assert sorted((r["key"], r["size"]) for r in got) == sorted(
        [(f"en/{name}", n % 5) for n, name in enumerate(names)] + [("en/deep/er", 1)]
    )
    seen = [(f.name.rsplit("-", 5)[0], int(f.read_text())) for f in calls.iterdir()]
    assert max(n for _, n in seen) == 100 and len({task for task, _ in seen}) > 15


@given(names=st.lists(st.text(min_size=1, max_size=4), min_size=1, max_size=30, unique=True), page=st.integers(1, 5))
@settings(deadline=None, max_examples=200)
def test_ranges_cover_every_name_once(names, page):
    """Pages and the ranges that they leave give each name once, whatever the names."""
    left, found = [("", None)], []
    while left:
        after, upto = left.pop()
        own = sorted(n for n in names if n > after and (upto is None or n <= upto))[:page]
        found += own
        if len(own) >= page:
            left += cut_range(own, upto)
    assert sorted(found) == sorted(names)

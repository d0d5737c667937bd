"""Tables in clusters: same rows as whole rewrites, and only touched clusters read and written."""

import random

import pytest
from pyspark.sql import functions as F

from shardlens.operators import lookup
from shardlens.sources.clustered import ClusteredTable, create_clustered

SCHEMA = "id long, part string, grp long, v string"
ORDER = ["v"]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def row(n, v, grp=None):
    return (n, f"p{n % 3}", n % 7 if grp is None else grp, v)


@pytest.fixture
def table(spark, tmp_path):
    return create_clustered(frame(spark, [row(n, "old") for n in range(300)]), f"{tmp_path}/t", ["id", "part"], 32, ORDER)


def folders(table):
    return {f["cluster"]: f["lot"] for f in table.folders if f["gone"] is None}


def test_an_upsert_rewrites_its_clusters_and_old_versions_stay(spark, table):
    before, old = folders(table), rows_of(table.read())
    after = table.upsert(frame(spark, [row(1, "b"), row(1, "a"), row(2, "n"), row(1000, "n")]), ORDER)
    now = folders(after)
    changed = {c for c in now if now[c] != before.get(c)}
    assert 1 <= len(changed) <= 3 and len(before) == 32
    expected = [r for r in old if r[0] not in (1, 2)] + [row(1, "a"), row(2, "n"), row(1000, "n")]
    assert rows_of(after.read()) == sorted(expected)
    assert rows_of(table.read()) == old
    assert rows_of(ClusteredTable(spark, table.path).read()) == sorted(expected)
    assert rows_of(ClusteredTable(spark, table.path, table.version).read()) == old
    # What a reader of few keys opens, and what the upsert had to open.
    one = table.lookup(spark.createDataFrame([(5, "p2"), (5, "p0")], "id long, part string"))
    assert rows_of(one) == [row(5, "old")]
    assert len({f for f in one.inputFiles() if "/rows/" in f}) <= 2


def test_insert_keeps_rows_of_the_table(spark, table):
    after = table.insert(frame(spark, [row(1, "new"), row(301, "z"), row(301, "y")]), ORDER)
    assert rows_of(after.read()) == sorted([*rows_of(table.read()), row(301, "y")])


def test_deletes_write_keys_only_and_are_folded_in(spark, table):
    gone = table.delete(spark.createDataFrame([(1, "p1"), (2, "p0"), (None, "p1")], "id long, part string"))
    assert folders(gone) == folders(table) and len(rows_of(gone.read())) == 299
    wide = gone.delete(spark.createDataFrame([(3,), (None,)], "grp long"))
    left = [r for r in rows_of(table.read()) if r[0] != 1 and r[2] != 3]
    assert folders(wide) == folders(table) and rows_of(wide.read()) == left
    # A row that comes again after its delete stays.
    again = wide.upsert(frame(spark, [row(1, "again"), row(3, "again")]), ORDER)
    assert rows_of(again.read()) == sorted([*left, row(1, "again"), row(3, "again")])
    folded = again.fold()
    assert all(f["gone"] is None for f in folded.folders) and rows_of(folded.read()) == rows_of(again.read())
    assert folded.fold().version == folded.version


def test_random_writes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup.without_keys, "__defaults__", (0,))  # by the filter and the exact join
    rng = random.Random(3)
    start = [row(n, "a") for n in range(40)]
    table, held = create_clustered(frame(spark, start), f"{tmp_path}/t", ["id", "part"], 4, ORDER), {r[:2]: r for r in start}
    for step in range(6):
        picked = [row(rng.randrange(60), f"s{step}") for _ in range(8)]
        if step % 3 == 0:
            table = table.upsert(frame(spark, picked), ORDER)
            held.update({r[:2]: r for r in picked})
        elif step % 3 == 1:
            table = table.delete(frame(spark, picked).select("part", "id"))
            held = {k: r for k, r in held.items() if k not in {p[:2] for p in picked}}
        else:
            table = table.insert(frame(spark, picked), ORDER)
            held = {**{r[:2]: r for r in picked}, **held}
    assert rows_of(table.read()) == sorted(held.values())


def test_empty_tables_nulls_and_dead_writers(spark, tmp_path, table):
    empty = create_clustered(frame(spark, []), f"{tmp_path}/e", ["id"], 8, ORDER)
    assert empty.read().count() == 0 and empty.read().columns == ["id", "part", "grp", "v"]
    filled = empty.upsert(frame(spark, [row(1, "x")]), ORDER)
    assert rows_of(filled.read()) == [row(1, "x")]
    emptied = filled.delete(frame(spark, [row(1, "x")]).select("id")).fold()
    assert emptied.read().count() == 0 and emptied.folders == []
    with pytest.raises(ValueError, match="NULL"):
        empty.upsert(frame(spark, [(None, "p", 1, "x")]), ORDER)
    with pytest.raises(ValueError, match="folders"):
        create_clustered(spark.range(1).withColumn("cluster", F.lit(1)), f"{tmp_path}/x", ["id"], 2, ORDER)
    # A version without its marker does not count, and the next writer takes its number.
    lost = tmp_path / "t" / "versions" / str(table.version + 1)
    lost.mkdir()
    (lost / "part-0.json").write_text('{"cluster": 1')
    seen = ClusteredTable(spark, table.path)
    assert seen.version == table.version
    assert len(rows_of(seen.upsert(frame(spark, [row(900, "n")]), ORDER).read())) == 301

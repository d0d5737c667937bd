"""Every registered query against its SQL, row by row."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_queries import ORACLE
from shardlens.plans.registered import QUERIES
from tests.conftest import TESTDATA

SCALE = TESTDATA / "sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in SCALE.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain_type(name):
    """Spark's and DuckDB's names of the same types."""
    return {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE",
    }.get(name, name)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_names_every_query():
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    ours = queries()[name](spark, str(SCALE))
    columns = sorted(ours.columns)
    theirs = duck.execute(oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in theirs.description}
    assert sorted(types) == columns
    place = [[d[0] for d in theirs.description].index(c) for c in columns]
    expected = ordered([tuple(r[i] for i in place) for r in theirs.fetchall()])
    assert expected, "nothing to compare"
    assert {c: plain_type(t) for c, t in ours.dtypes} == types
    assert ordered([tuple(r) for r in ours.select(*columns).collect()]) == expected


def test_flagship_has_rows(spark):
    rows = entry(spark).collect()
    assert rows and all(r.visible + r.errors <= r.total for r in rows)

"""Registered queries against their SQL, and that all are registered."""

import duckdb
import pytest

from shardlens.llm.registered import ORACLE, QUERIES
from __spark_entry__ import oracle_sql, queries
from tests.conftest import TESTDATA


def test_all_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()
    assert "pipeline" in queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    folder = TESTDATA / "sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(expected, key=str)

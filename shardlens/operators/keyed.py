"""Keyed writes as DataFrame to DataFrame: insert-ignore, upsert, cascading delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.durable import store
from shardlens.operators.lookup import known_keys, lookup_join, without_keys


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Copies are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def absent_rows(target: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `first` (one per key) whose key `target` lacks.

    A small `first` leaves a large `target` unshuffled. `first` is read more
    than once, so hand in a stored or persisted frame.
    """
    return first.join(known_keys(first.select(*keys), target), keys, "left_anti")


def rows_to_insert(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of `new` that an insert-ignore would add: first per key, key not in `target`."""
    return absent_rows(target, store(first_per_key(new, keys, order), "first"), keys)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`target` plus the first new row of every key it lacks. `target` rows always win."""
    added = rows_to_insert(target, new, keys, order)
    return target.unionByName(added.select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` replaces rows of `target` with the same key; other rows of `target` stay."""
    kept = without_keys(target, new.select(*keys))
    return kept.select(*target.columns).unionByName(new.select(*target.columns))


def delete_queries(
    queries: DataFrame, jobs: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove the queries listed in `ids` (column query_id), and their jobs."""
    gone = ids.select("query_id").distinct()
    queries_left = queries.join(gone, queries["id"] == gone["query_id"], "left_anti")
    return queries_left, lookup_join(jobs, gone, ["query_id"], ["job_id"], "left_anti")

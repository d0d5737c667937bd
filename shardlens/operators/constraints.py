"""Table constraints: rows that break one are set aside, with the reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.operators.lookup import lookup_join
from shardlens.schemas import TABLE_RULES, UNIQUE_KEYS


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add absent columns with their defaults. A NULL that was given stays NULL."""
    absent = {
        r.column: F.lit(r.default).cast(r.type)
        for r in TABLE_RULES[table]
        if r.column not in df.columns
    }
    return df.withColumns(absent) if absent else df


def _violations(table: str) -> list[tuple[Column, str]]:
    """(broken, reason) for every NOT NULL, width and status rule, in column order."""
    found = []
    for rule in TABLE_RULES[table]:
        value = F.col(rule.column)
        if rule.required:
            found.append((value.isNull(), f"{rule.column}: missing"))
        if rule.width is not None:
            found.append((F.char_length(value) > rule.width, f"{rule.column}: too wide"))
        if rule.allowed is not None:
            found.append((~value.isin(*rule.allowed), f"{rule.column}: not allowed"))
    return found


def keeps_rules(table: str) -> Column:
    """Whether a row breaks no rule. An unknown answer, as for a NULL status, breaks none."""
    broken = reduce(lambda x, y: x | y, [condition for condition, _ in _violations(table)])
    return ~F.coalesce(broken, F.lit(False))


def broken_rules(table: str) -> Column:
    """The reasons why a row cannot be taken."""
    return F.array_compact(F.array(*[F.when(c, reason) for c, reason in _violations(table)]))


def check_constraints(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split into (ok, rejected). Rejected rows carry `reasons`."""
    filled = with_defaults(df, table)
    rejected = filled.where(~keeps_rules(table)).withColumn("reasons", broken_rules(table))
    return filled.where(keeps_rules(table)), rejected


def unique_violations(df: DataFrame, keys: list[str] | str) -> DataFrame:
    """Keys held by more than one row, with their `count`. `keys` may name a table."""
    columns = UNIQUE_KEYS[keys] if isinstance(keys, str) else keys
    present = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    return present.groupBy(*columns).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def orphan_jobs(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """Jobs whose query does not exist."""
    known = queries.select(F.col("id").alias("query_id"))
    return lookup_join(jobs, known, ["query_id"], ["job_id"], "left_anti")


def check_page(page: int) -> int:
    """Pages start at 1."""
    if isinstance(page, bool) or not isinstance(page, int) or page < 1:
        raise ValueError(f"page must be a whole number from 1 on, not {page!r}")
    return page

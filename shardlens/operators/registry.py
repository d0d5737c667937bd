"""Registered queries: bulk registration and the views their owners get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.functions.wire import to_wire
from shardlens.operators.constraints import check_constraints
from shardlens.operators.lookup import lookup_join
from shardlens.operators.numbering import number_rows
from shardlens.schemas import PENDING, PUBLISHED

QUERY_COLUMNS = [
    "id", "dataset", "language", "query_text", "model", "owner", "status", "created_at",
]


def assign_ids(requests: DataFrame, queries: DataFrame) -> DataFrame:
    """Give requests the ids after the highest one in use, in the order of their fields."""
    highest = queries.agg(F.max("id").alias("id")).first()["id"] or 0
    numbered = number_rows(requests, [], requests.columns, name="query_id")
    return numbered.withColumn("query_id", F.col("query_id") + F.lit(highest + 1))


def register_queries(requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Turn requests (query_id, dataset, language, query_text, model, user) into queries.

    They are pending unless `requests` has a status. Returns (queries, rejected).
    """
    status = F.col("status") if "status" in requests.columns else F.lit(PENDING)
    rows = requests.select(
        F.col("query_id").cast("bigint").alias("id"),
        "dataset",
        "language",
        "query_text",
        "model",
        F.col("user").alias("owner"),
        status.alias("status"),
        as_of.alias("created_at"),
    )
    return check_constraints(rows, "queries")


def mark_published(queries: DataFrame, acks: DataFrame) -> DataFrame:
    """Queries with at least one acknowledged batch become `published`."""
    done = acks.where(F.size("ids") > 0).select("query_id").distinct()
    flagged = queries.join(
        done.select(F.col("query_id").alias("id"), F.lit(True).alias("_done")), "id", "left"
    )
    status = F.when(F.col("_done"), PUBLISHED).otherwise(F.col("status"))
    return flagged.withColumn("status", status).select(*queries.columns)


def owned_queries(queries: DataFrame, owner: str | None = None) -> DataFrame:
    """Details of one owner's queries, or of all queries with their owner."""
    details = queries.select(
        F.col("id").alias("query_id"), "dataset", "query_text", "model", "language", "created_at",
        "owner",
    )
    return details if owner is None else details.where(F.col("owner") == owner).drop("owner")


def query_context(queries: DataFrame, query_id: int | None = None) -> DataFrame:
    """Text and model, of one query or of all."""
    context = queries.select(F.col("id").alias("query_id"), "query_text", "model")
    return context if query_id is None else context.where(F.col("query_id") == query_id)


def attach_context(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """Add the text and model of its query to every job."""
    return lookup_join(jobs, query_context(queries), ["query_id"], ["job_id"])


def queries_with_jobs(queries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queries having at least one job of any status."""
    # Distinct ids first: one query may hold most jobs.
    having = jobs.select(F.col("query_id").alias("id")).distinct()
    return queries.join(having, "id", "left_semi")


def eligible_queries(queries: DataFrame, jobs: DataFrame, owner: str | None = None) -> DataFrame:
    """Queries whose results may be read: status known and not pending, and jobs exist."""
    ready = queries.where(F.col("status") != PENDING)
    if owner is not None:
        ready = ready.where(F.col("owner") == owner)
    return queries_with_jobs(ready, jobs)


# Messages about queries, one row each; a list of an owner's queries is their rows joined by the reader.


def detail_messages(queries: DataFrame) -> DataFrame:
    """(query_id, owner, body): the details of every query for its owner."""
    fields = ["query_id", "dataset", "query_text", "model", "language", "created_at"]
    return to_wire(owned_queries(queries), fields).select("query_id", "owner", "body")


def context_messages(queries: DataFrame) -> DataFrame:
    """(query_id, body): text and model of every query for the classifier."""
    named = queries.withColumnRenamed("id", "query_id")
    return to_wire(named, ["query_text", "model"]).select("query_id", "body")


def registration_messages(queries: DataFrame) -> DataFrame:
    """(query_id, body): the answer to every registration."""
    named = queries.select(F.col("id").alias("query_id"))
    return to_wire(named, ["query_id"])

"""Counts and progress of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shardlens.functions.outcomes import is_visible
from shardlens.schemas import ERROR, PENDING, PROCESSED


def _or_zero(*names: str) -> dict:
    return {n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names}


def _with_dataset_size(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    sizes = catalog.groupBy(F.col("name").alias("dataset"), "language").agg(
        F.count("*").alias("dataset_size")
    )
    return queries.join(sizes, ["dataset", "language"], "left").withColumns(_or_zero("dataset_size"))


def shard_count(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, dataset_size): shards in each query's dataset and language."""
    sized = _with_dataset_size(queries.select("id", "dataset", "language"), catalog)
    return sized.select(F.col("id").alias("query_id"), "dataset_size")


def job_facts(jobs: DataFrame) -> DataFrame:
    """Per query: all jobs, and jobs by state."""
    return jobs.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == PENDING).alias("pending"),
        F.count_if(F.col("status") == PROCESSED).alias("processed"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
        F.count_if(is_visible(jobs)).alias("visible"),
        F.max("finished_at").alias("last_finished_at"),
    )


def job_rollup(queries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job facts of every query, zeros for queries without jobs."""
    facts = job_facts(jobs)
    joined = queries.select(F.col("id").alias("query_id")).join(facts, "query_id", "left")
    return joined.withColumns(_or_zero("total", "pending", "processed", "errors", "visible"))


def query_status(queries: DataFrame, catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per query: dataset, processed_records, created_at, language, dataset_size, query_results_count.

    A job counts as processed once it has an outcome, matches or error.
    """
    counts = jobs.groupBy("query_id").agg(
        F.count("*").alias("query_results_count"),
        F.count_if(F.col("status") != PENDING).alias("processed_records"),
    )
    known = queries.select(F.col("id").alias("query_id"), "dataset", "created_at", "language")
    return (
        _with_dataset_size(known, catalog)
        .join(counts, "query_id", "left")
        .withColumns(_or_zero("query_results_count", "processed_records"))
        .select(
            "query_id", "dataset", "processed_records", "created_at", "language",
            "dataset_size", "query_results_count",
        )
    )


def query_counters(
    queries: DataFrame, contexts: DataFrame, jobs: DataFrame, callbacks: DataFrame
) -> DataFrame:
    """Per query: contexts published, jobs created, callbacks accepted, jobs finished.

    Short acks make jobs fewer than contexts; repeats make callbacks more than jobs.
    """
    published = contexts.groupBy("query_id").agg(F.count("*").alias("published"))
    per_job = callbacks.groupBy("job_id").agg(F.count("*").alias("_calls"))
    counted = (
        jobs.select("query_id", "job_id")
        .join(per_job, "job_id", "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("jobs_created"),
            F.sum("_calls").alias("callbacks_accepted"),
            F.count("_calls").alias("jobs_finished"),
        )
    )
    names = ["published", "jobs_created", "callbacks_accepted", "jobs_finished"]
    return (
        queries.select(F.col("id").alias("query_id"))
        .join(published, "query_id", "left")
        .join(counted, "query_id", "left")
        .withColumns(_or_zero(*names))
        .select("query_id", *names)
    )


def progress(queries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job totals of every query whose results may be read.

    The facts hold a row for exactly the queries with a job, so one pass over
    the jobs both tests eligibility and counts.
    """
    ready = queries.where(F.col("status") != PENDING).select(F.col("id").alias("query_id"))
    return ready.join(job_facts(jobs), "query_id").select(
        "query_id", "total", "visible", "processed", "errors"
    )

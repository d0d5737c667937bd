"""The three flows of the service, each as a few bulk jobs over stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.durable import store
from shardlens.operators.constraints import check_page
from shardlens.operators import ingest, keyed, publish, registry, results, running_stats
from shardlens.schemas import BATCH_SIZE, PAGE_SIZE
from shardlens.sources.tables import read_table, write_table


def refresh_catalog(
    listing: DataFrame, catalog: DataFrame, stats: DataFrame, loads: DataFrame,
    as_of: Column, out: str, resume: bool = False, changes: tuple[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Load all `loads` and renew the statistics. Writes new snapshots below `out`.

    Objects that could not be taken are written to `load_rejects`, with reasons, and
    the counts of the load to `load_report`, in one row. `changes`, a folder and this load's
    batch number there, has the running statistics take what the load added.
    """
    spark = listing.sparkSession
    load = ingest.reported_load(listing, catalog, loads, as_of, resume)
    after = load.catalog
    write_table(after, f"{out}/datasets", "datasets")
    write_table(load.rejects, f"{out}/load_rejects", "load_rejects")
    if changes is not None:
        running_stats.record_changes(*changes, load.added)
    counts = ", ".join(f"{name} bigint" for name in load.report)
    write_table(spark.createDataFrame([tuple(load.report.values())], counts), f"{out}/load_report", "load_report")
    loaded = read_table(spark, f"{out}/datasets", after.schema)
    write_table(ingest.update_stats(stats, loaded, as_of), f"{out}/dataset_stats", "dataset_stats")
    return loaded, read_table(spark, f"{out}/dataset_stats", stats.schema)


@dataclass(frozen=True)
class Published:
    """Outcome of a publish run: contexts sent, and queries that have no shard."""

    contexts: DataFrame
    without_shards: DataFrame


def publish_queries(
    queries: DataFrame, catalog: DataFrame, out: str, batch_size: int = BATCH_SIZE
) -> Published:
    """Write one request per batch of every query below `out`."""
    contexts = store(publish.batch_number(queries, catalog, batch_size), "contexts")
    publish.write_batches(publish.batch_requests(contexts), f"{out}/requests")
    return Published(contexts, publish.queries_without_shards(queries, catalog))


def accept_acks(
    queries: DataFrame, jobs: DataFrame | None, contexts: DataFrame, acks: DataFrame,
    as_of: Column, out: str,
) -> tuple[DataFrame, DataFrame]:
    """Add the acknowledged jobs to `jobs` and mark their queries published.

    A job id that exists already is not added again. Writes new snapshots below `out`.
    """
    spark = queries.sparkSession
    added = publish.attach_job_ids(contexts, acks, as_of)
    order = [F.col("query_id"), F.col("data_id")]
    if jobs is None:
        added = keyed.first_per_key(added, ["job_id"], order)
    else:
        added = jobs.unionByName(
            keyed.rows_to_insert(jobs, added, ["job_id"], order), allowMissingColumns=True
        )
    write_table(added, f"{out}/query_results", "query_results")
    write_table(registry.mark_published(queries, acks), f"{out}/queries", "queries")
    return read_table(spark, f"{out}/queries"), read_table(spark, f"{out}/query_results")


def settle_jobs(
    jobs: DataFrame, callbacks: DataFrame, out: str, page_size: int = PAGE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """Merge callbacks, set unknown ones aside and build result pages, all below `out`."""
    spark = jobs.sparkSession
    write_table(results.merge_callbacks(jobs, callbacks), f"{out}/query_results", "query_results")
    write_table(results.unknown_callbacks(callbacks, jobs), f"{out}/unknown_callbacks", "unknown_callbacks")
    merged = read_table(spark, f"{out}/query_results")
    write_table(results.build_pages(merged, page_size), f"{out}/pages", "pages")
    return merged, read_table(spark, f"{out}/pages")


def owner_page(
    queries: DataFrame, jobs: DataFrame, pages: DataFrame, owner: str, query_id: int, page: int = 1,
    page_size: int = PAGE_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """One stored page and its summary, both empty if `owner` may not read the query."""
    check_page(page)
    mine = queries.where(F.col("id") == query_id)
    own_jobs = jobs.where(F.col("query_id") == query_id)
    allowed = registry.eligible_queries(mine, own_jobs, owner).select(F.col("id").alias("query_id"))
    at_page = (F.col("query_id") == query_id) & (F.col("page") == page)
    summary = results.page_summary(own_jobs, page_size).where(at_page)
    rows = pages.where(at_page).join(allowed, "query_id", "left_semi").orderBy("pos")
    return rows, summary.join(allowed, "query_id", "left_semi")

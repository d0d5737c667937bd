"""Result pages that stay: later jobs go on where the pages end, and an index names the files of a page.

A batch of pages is a folder of its own, `<out>/pages/batch=<n>`, with an entry in
`<out>/index/batch=<n>` for each query in each of its files. Jobs that are on a page
never move. Replaying the last batch replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.durable import store
from shardlens.operators.constraints import check_page
from shardlens.operators.lookup import lookup_join
from shardlens.operators.numbering import number_rows
from shardlens.operators.results import visible_results
from shardlens.schemas import PAGE_SIZE

INDEX = "query_id bigint, file string, jobs bigint, first_nth bigint, last_nth bigint, batch int"


def page_index(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(query_id, file, jobs, first_nth, last_nth, batch) of all batches, or of those before one."""
    folder = f"{out}/index"
    index = spark.read.schema(INDEX).option("basePath", folder).option("ignoreMissingFiles", "true")
    numbers = range(before) if before is not None else None
    if numbers is None:
        return index.parquet(folder)
    return index.parquet(*[f"{folder}/batch={n}" for n in numbers]) if numbers else spark.createDataFrame([], INDEX)


def append_pages(
    jobs: DataFrame, out: str, batch: int, page_size: int = PAGE_SIZE, order: str = "data_id"
) -> None:
    """Put visible jobs that are on no page yet behind the last one of their query, in `order`.

    Batches are numbered 0, 1, 2, ... Numbers go on from the index, so no page is read
    but for the ids on it. Queries without a visible job have no page; an empty batch is
    written all the same. Jobs that are deleted later keep their place.
    """
    spark = jobs.sparkSession
    visible = visible_results(jobs)
    ids = visible.select("query_id", order, "job_id")
    ends = page_index(spark, out, batch).groupBy("query_id").agg(F.sum("jobs").alias("_before"))
    if batch:
        ids = ids.join(_paged_ids(spark, out, batch), "job_id", "left_anti")
    nth = F.col("_seq") + F.coalesce("_before", F.lit(0))
    numbered = number_rows(ids, ["query_id"], [order, "job_id"], name="_seq")
    # A control row per query; a query may hold a third of all jobs.
    placed = lookup_join(numbered, store(ends, "ends"), ["query_id"], ["job_id"], "left").select(
        "job_id", nth.alias("nth")
    )
    rows = visible.join(placed, "job_id").select(
        *visible.columns, "nth", F.expr(f"nth div {int(page_size)} + 1").alias("page"),
        (F.col("nth") % page_size).cast("int").alias("pos"),
    )
    folder = f"{out}/pages/batch={batch}"
    rows.repartitionByRange("query_id", "nth").sortWithinPartitions("query_id", "nth").write.mode("overwrite").parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder).select("query_id", "nth", F.col("_metadata.file_name").alias("file"))
    written.groupBy("query_id", "file").agg(
        F.count("*").alias("jobs"), F.min("nth").alias("first_nth"), F.max("nth").alias("last_nth")
    ).write.mode("overwrite").parquet(f"{out}/index/batch={batch}")


def _paged_ids(spark: SparkSession, out: str, batch: int) -> DataFrame:
    folders = [f"{out}/pages/batch={n}" for n in range(batch)]
    return spark.read.schema("job_id string").parquet(*folders)


def stable_pages(spark: SparkSession, out: str) -> DataFrame:
    """All jobs on pages, with `nth` in their query, `page` and `pos`."""
    return spark.read.parquet(f"{out}/pages").drop("batch")


def files_of_page(spark: SparkSession, out: str, query_id: int, page: int, page_size: int = PAGE_SIZE) -> list[str]:
    """The files that hold a page: mostly one, a few where files or batches meet in it."""
    first = (check_page(page) - 1) * page_size
    found = page_index(spark, out).where(
        (F.col("query_id") == query_id) & (F.col("first_nth") < first + page_size) & (F.col("last_nth") >= first)
    )
    # Each file has a job on the page, so there are no more of them than jobs.
    return sorted(f"{out}/pages/batch={r['batch']}/{r['file']}" for r in found.select("batch", "file").collect())


def read_page(
    spark: SparkSession, out: str, query_id: int, page: int, page_size: int = PAGE_SIZE
) -> DataFrame:
    """The jobs of one page, in order; none beyond the last page. Opens the files of that page alone."""
    files = files_of_page(spark, out, query_id, page, page_size)
    if not files:
        return stable_pages(spark, out).where("false")
    on_page = (F.col("query_id") == query_id) & (F.col("page") == page)
    return spark.read.parquet(*files).where(on_page).orderBy("pos")

"""Merging callbacks into jobs, and paging through matches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from shardlens.durable import store
from shardlens.functions.outcomes import OUTCOME_FIELDS, is_visible, no_error, no_matches, outcome
from shardlens.functions.wire import to_wire
from shardlens.operators.constraints import check_page
from shardlens.operators.lookup import known_keys, lookup_join, rows_with_keys
from shardlens.operators.numbering import number_rows
from shardlens.schemas import PAGE_SIZE

# Above every number of a row, so that a time's multiples leave room for it.
_ROWS = Decimal(10) ** 19


def arrival_order():
    """Total order of callbacks: arrival time, then content."""
    return F.struct("received_at", F.md5(F.to_json(F.struct("matches", "error"))).alias("content"))


def moment(callbacks: DataFrame, name: str = "received_at") -> Column:
    """Microseconds of a time, in its order; no time comes before all others."""
    time = F.col(name)
    if isinstance(callbacks.schema[name].dataType, TimestampNTZType):
        # Read off the clock: a time zone would let an hour of autumn pass twice.
        seconds = F.unix_date(F.to_date(time)) * F.lit(86400).cast("bigint") + F.hour(time) * 3600 + F.minute(time) * 60
        micros = seconds * 1000000 + (F.date_part(F.lit("SECOND"), time) * 1000000).cast("bigint")
    else:
        micros = F.unix_micros(time)
    return F.coalesce(micros, F.lit(-(1 << 63)))


def last_rows(callbacks: DataFrame) -> DataFrame:
    """(job_id, _at, _row, _other): the time of each job's last callbacks, and their largest and smallest `_row`.

    One aggregate over ids and numbers. Time and row make one decimal, which Spark can
    reduce in place by hash; a struct or a payload would have it sort all rows.
    """
    time = F.col("_at").cast("decimal(19,0)") * F.lit(_ROWS)
    placed = callbacks.select(
        "job_id", "_at", (time + F.col("_row")).alias("_up"), (time + (F.lit(_ROWS) - 1 - F.col("_row"))).alias("_down")
    )
    best = placed.groupBy("job_id").agg(F.max("_at").alias("_at"), F.max("_up").alias("_up"), F.max("_down").alias("_down"))
    return best.select(
        "job_id", "_at", (F.col("_up") - time).cast("bigint").alias("_row"),
        (F.lit(_ROWS) - 1 - (F.col("_down") - time)).cast("bigint").alias("_other"),
    )


def last_outcomes(callbacks: DataFrame) -> DataFrame:
    """(job_id, outcome) of each job's last callback: the latest, and at equal times the largest content.

    The callbacks are written once, with a number for each row. Ids, times and these numbers choose the
    last one; then only chosen rows are shuffled with their payload. Contents are compared
    where a job has several callbacks of its last time, and nowhere else.
    """
    named = callbacks.where(F.col("job_id").isNotNull()).select("job_id", "matches", "error", "received_at")
    numbered = named.select("*", moment(named).alias("_at"), F.monotonically_increasing_id().alias("_row"))
    stored = store(numbered, "callbacks")
    last = store(last_rows(stored), "last")
    sole = rows_with_keys(stored, last.where("_row = _other").select("_row"))
    found = outcome(F.col("received_at")).alias("outcome")
    tied = lookup_join(
        stored, last.where("_row <> _other").select("job_id", "_at"), ["job_id", "_at"], ["_row"], "left_semi"
    )
    chosen = tied.select("job_id", found, arrival_order().alias("_order")).groupBy("job_id").agg(
        F.max_by("outcome", "_order").alias("outcome")
    )
    return sole.select("job_id", found).unionByName(chosen)


def with_outcome_columns(jobs: DataFrame, time_type) -> DataFrame:
    """Add the outcome columns pending jobs do not have yet."""
    absent = {
        "matches": no_matches(), "error": no_error(), "finished_at": F.lit(None).cast(time_type),
        "has_payload": F.lit(False),
    }
    new = {name: value for name, value in absent.items() if name not in jobs.columns}
    return jobs.withColumns(new) if new else jobs


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Replace the whole outcome of each job that has a new one.

    Field by field, an empty outcome would leave old matches in place.
    """
    jobs = with_outcome_columns(jobs, outcomes.schema["outcome"].dataType["finished_at"].dataType)
    old = F.struct(*[F.col(c) for c in OUTCOME_FIELDS])
    merged = jobs.join(outcomes, "job_id", "left").withColumn("_now", F.coalesce("outcome", old))
    kept = [F.col(c) for c in jobs.columns if c not in OUTCOME_FIELDS]
    return merged.select(*kept, "_now.*")


def merge_callbacks(jobs: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Jobs after all `callbacks` (job_id, error, matches, received_at); the last one counts."""
    # Stored, the outcomes show their true size: if few, Spark leaves the jobs unshuffled.
    return apply_outcomes(jobs, store(last_outcomes(callbacks), "outcomes"))


def unknown_callbacks(callbacks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Callbacks that name no job, also those without any id."""
    # Ids are reduced before they meet the jobs: one id may hold most callbacks.
    named = callbacks.where(F.col("job_id").isNotNull())
    ids = store(named.select("job_id").distinct(), "ids")
    unknown = store(ids.join(known_keys(ids, jobs), "job_id", "left_anti"), "unknown")
    found = lookup_join(named, unknown, ["job_id"], ["received_at", "matches"], "left_semi")
    return found.unionByName(callbacks.where(F.col("job_id").isNull()))


def visible_results(jobs: DataFrame) -> DataFrame:
    return jobs.where(is_visible(jobs))


def result_total(jobs: DataFrame) -> DataFrame:
    """Jobs of any status per query."""
    return jobs.groupBy("query_id").agg(F.count("*").alias("total"))


def build_pages(jobs: DataFrame, page_size: int = PAGE_SIZE, order: str = "data_id") -> DataFrame:
    """Visible jobs with their `page` (from 1) and `pos` on it, for all queries at once.

    A page is then read by a filter, however deep it lies. Only ids are numbered;
    payloads meet their place once. Pages follow `order` (unique in a query), so
    jobs of a later publish may stand on earlier pages; pages are built anew then.
    """
    visible = visible_results(jobs)
    places = number_rows(
        visible.select("query_id", order, "job_id"), ["query_id"], [order, "job_id"], name="_nth"
    ).select(
        "job_id",
        F.expr(f"_nth div {int(page_size)} + 1").alias("page"),
        (F.col("_nth") % page_size).cast("int").alias("pos"),
    )
    return visible.join(places, "job_id").select(*visible.columns, "page", "pos")


def results_page(
    jobs: DataFrame, query_id: int, page: int = 1, page_size: int = PAGE_SIZE, order: str = "data_id"
) -> DataFrame:
    """One page of one query, without stored pages. Meant for early pages."""
    check_page(page)
    visible = visible_results(jobs.where(F.col("query_id") == query_id))
    return visible.orderBy(order).offset((page - 1) * page_size).limit(page_size)


def page_summary(jobs: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per page of every query: total, visible_total, page, page_size, has_more.

    Pages are counted by `total`, all jobs of any status, and so is has_more;
    `visible_total` counts the jobs that are really shown.
    """
    totals = jobs.groupBy("query_id").agg(
        F.count("*").alias("total"), F.count_if(is_visible(jobs)).alias("visible_total")
    )
    last = F.expr(f"(total - 1) div {int(page_size)} + 1")
    pages = F.sequence(F.lit(1).cast("bigint"), last)
    return totals.withColumn("page", F.explode(pages)).select(
        "query_id", "total", "visible_total", "page",
        F.lit(page_size).alias("page_size"),
        (F.col("total") > F.col("page") * page_size).alias("has_more"),
    )


def explode_matches(jobs: DataFrame) -> DataFrame:
    """(query_id, job_id, uri, text) of every match."""
    return jobs.select("query_id", "job_id", F.inline("matches"))


def page_messages(pages: DataFrame, summary: DataFrame) -> DataFrame:
    """(query_id, page, pos, body): the messages of every page, a row for each job.

    Row -1 of a page is its head (total, page, pageSize, has_more), the others
    hold the results of one job, so no row grows with a page. `page_message` puts one page together.
    """
    heads = to_wire(summary, ["total", "page", "page_size", "has_more"]).select("query_id", "page", F.lit(-1).alias("pos"), "body")
    jobs = to_wire(pages.withColumnRenamed("matches", "results"), ["results"])
    return heads.unionByName(jobs.select("query_id", "page", "pos", "body"))


def page_message(messages: DataFrame, query_id: int, page: int) -> str | None:
    """The whole JSON message of one page for its reader; None if there is no such page."""
    check_page(page)
    rows = messages.where((F.col("query_id") == query_id) & (F.col("page") == page)).orderBy("pos").collect()
    if not rows:
        return None
    head = next(r["body"] for r in rows if r["pos"] < 0)
    return '{"results":[' + ",".join(r["body"] for r in rows if r["pos"] >= 0) + "]," + head[1:]

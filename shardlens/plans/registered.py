"""One query per operator, over the given tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardlens.durable import durable_folder, store
from shardlens.fixtures import Inputs, as_of
from shardlens.functions.keys import object_key
from shardlens.functions.outcomes import outcome
from shardlens.functions.wire import to_wire
from shardlens.operators import (
    constraints, ingest, keyed, publish, registry, results, running_stats as running, stable_pages as stable, status,
)
from shardlens.operators.classify import Classifier, big_shards, classify
from shardlens.plans import lifecycle
from shardlens.sources import clustered, listing, records, requests as request_source, tables
from shardlens.sources.callbacks import check_messages, decode_callbacks as decode, read_callbacks as read
from shardlens.streaming import callbacks as streaming, deadlines, listing as listing_streaming

# Small sizes, so that small data has several batches and pages a query, and some big shards.
BATCH = 7
PAGE = 5
BIG = 5000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Inputs(spark, folder))
    return build


def matches_text() -> Column:
    """A match list as one comparable text."""
    lines = F.transform("matches", lambda m: F.concat_ws("=", m["uri"], m["text"]))
    return F.md5(F.array_join(lines, "\n")).alias("matches_md5")


def with_plain_outcome(jobs: DataFrame, *keys: str) -> DataFrame:
    return jobs.select(
        *keys, "status", F.size("matches").alias("n_matches"), matches_text(),
        F.col("error.code").alias("error_code"), "finished_at",
    )


def contexts(inputs: Inputs) -> DataFrame:
    return publish.batch_number(inputs.queries(), inputs.catalog(), BATCH)


def resume_points(inputs: Inputs) -> DataFrame:
    after = ingest.last_key(inputs.known_catalog()).withColumnRenamed("last_key", "start_after")
    return inputs.loads().join(after, ["name", "data_type"], "left")


# Scans


def new_folder(inputs: Inputs, label: str) -> str:
    return f"{durable_folder(inputs.spark)}/runs/{label}-{uuid.uuid4().hex}"


def stored_catalog(inputs: Inputs) -> str:
    """Write the catalogue as its own table and return the path."""
    path = new_folder(inputs, "catalog")
    tables.write_table(inputs.catalog(), path, "datasets")
    return path


@registered
def listing_scan(inputs: Inputs) -> DataFrame:
    """A folder of objects on disk: one a document, some empty, some with hidden names."""
    shared = durable_folder(inputs.spark).removeprefix("file:")
    root = f"{shared}/runs/objects-{uuid.uuid4().hex}"
    write_objects(stored_objects(inputs), root)
    return listing.scan_listing(inputs.spark, root)


def stored_objects(inputs: Inputs) -> DataFrame:
    return inputs.documents().select(
        F.concat_ws(
            "/", "source", F.when(F.col("doc_id") % 5 == 0, "_hidden").otherwise("text"), "lang",
            F.concat(F.when(F.col("doc_id") % 7 == 0, ".").otherwise(""), F.md5(F.col("doc_id").cast("string"))),
        ).alias("key"),
        F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("doc_id") % 100).cast("int").alias("size"),
    )


def write_objects(objects: DataFrame, root: str) -> None:
    def write(rows) -> None:
        from pathlib import Path

        for row in rows:
            file = Path(root, row["key"])
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(b"x" * row["size"])

    objects.foreachPartition(write)


@registered
def catalog_roundtrip(inputs: Inputs) -> DataFrame:
    """The catalogue as it is read back, with languages that look like nothing, numbers and dates."""
    odd = F.when(F.col("byte_size") % 4 == 0, "").when(F.col("byte_size") % 4 == 1, "007").when(
        F.col("byte_size") % 4 == 2, "2024-01-01"
    ).otherwise(F.col("language"))
    path = new_folder(inputs, "catalog")
    tables.write_table(inputs.catalog().withColumn("language", odd), path, "datasets")
    return tables.read_table(inputs.spark, path).select("name", "language", "md5", "byte_size", "created_at")


@registered
def scan_catalog(inputs: Inputs) -> DataFrame:
    return tables.scan_catalog(inputs.spark, stored_catalog(inputs), language="en").select(
        "name", "language", "data_type", "md5", "byte_size"
    )


@registered
def scan_catalog_of_dataset(inputs: Inputs) -> DataFrame:
    return tables.scan_catalog(inputs.spark, stored_catalog(inputs), "src0", "en").select(
        "name", "language", "data_type", "md5", "byte_size"
    )


@registered
def batch_summary(inputs: Inputs) -> DataFrame:
    data = F.col("data")
    return publish.batch_requests(contexts(inputs)).select(
        "query_id",
        "batch_no",
        F.size(data).alias("n_contexts"),
        F.array_join(data["dataUrl"], ",").alias("data_urls"),
        F.aggregate(data, F.lit(0).cast("bigint"), lambda s, c: s + c["bytesize"]).alias("bytes"),
    )


@registered
def scan_records(inputs: Inputs) -> DataFrame:
    return records.scan_records(inputs.table("documents"))


@registered
def record_counts(inputs: Inputs) -> DataFrame:
    return records.record_counts(inputs.table("documents"))


# Projections and filters


@registered
def parse_key(inputs: Inputs) -> DataFrame:
    valid, _ = ingest.split_valid(inputs.mixed_listing())
    return ingest.parse_keys(valid)


@registered
def rejected_keys(inputs: Inputs) -> DataFrame:
    return ingest.split_valid(inputs.mixed_listing())[1]


@registered
def prefix_listing(inputs: Inputs) -> DataFrame:
    return ingest.list_loads(inputs.mixed_listing(), inputs.loads())


@registered
def start_after_listing(inputs: Inputs) -> DataFrame:
    return ingest.list_loads(inputs.mixed_listing(), resume_points(inputs))


@registered
def rebuild_key(inputs: Inputs) -> DataFrame:
    return inputs.catalog().select("md5", object_key().alias("object_key"))


@registered
def loader_defaults(inputs: Inputs) -> DataFrame:
    return ingest.catalog_rows(inputs.mixed_listing(), as_of())


@registered
def job_contexts(inputs: Inputs) -> DataFrame:
    jobs = publish.fan_out(inputs.queries(), inputs.catalog())
    return publish.job_contexts(jobs).select(
        F.col("context.dataUrl").alias("data_url"),
        F.col("context.batchSize").alias("batch_size"),
        F.col("context.bytesize").alias("bytesize"),
        F.col("context.decompressedByteSize").alias("decompressed_byte_size"),
        F.col("context.checksumMd5").alias("checksum_md5"),
        F.col("context.classifierId").alias("classifier_id"),
    )


@registered
def visible_results(inputs: Inputs) -> DataFrame:
    return results.visible_results(inputs.jobs()).select("query_id", "job_id", matches_text())


@registered
def eligible_queries(inputs: Inputs) -> DataFrame:
    return registry.eligible_queries(inputs.queries(), inputs.open_jobs()).select(
        "id", "dataset", "language", "owner", "status"
    )


@registered
def eligible_queries_of_owner(inputs: Inputs) -> DataFrame:
    return registry.eligible_queries(inputs.queries(), inputs.open_jobs(), "u1").select(
        "id", "dataset", "language", "owner", "status"
    )


@registered
def owned_queries(inputs: Inputs) -> DataFrame:
    return registry.owned_queries(inputs.queries())


@registered
def owned_queries_of_owner(inputs: Inputs) -> DataFrame:
    return registry.owned_queries(inputs.queries(), "u1")


@registered
def query_context(inputs: Inputs) -> DataFrame:
    return registry.attach_context(inputs.open_jobs(), inputs.queries()).select(
        "query_id", "job_id", "query_text", "model"
    )


@registered
def job_outcome(inputs: Inputs) -> DataFrame:
    settled = inputs.callbacks().select(
        "job_id", "received_at", outcome(F.col("received_at")).alias("o")
    ).select("job_id", "received_at", "o.*")
    return with_plain_outcome(settled, "job_id", "received_at")


def request_lines(inputs: Inputs) -> DataFrame:
    fields = ["dataset", "language", "query_text", "model", "user"]
    return to_wire(inputs.requests(), fields, "value").select("value")


@registered
def register_queries(inputs: Inputs) -> DataFrame:
    return registry.register_queries(inputs.requests(), as_of())[0]


@registered
def register_rejects(inputs: Inputs) -> DataFrame:
    rejected = registry.register_queries(inputs.requests(), as_of())[1]
    return rejected.select("id", F.array_join("reasons", "; ").alias("reasons"))


@registered
def query_messages(inputs: Inputs) -> DataFrame:
    """The three messages about each query."""
    queries = inputs.queries()
    details = registry.detail_messages(queries).select("query_id", F.lit("details").alias("kind"), "body")
    context = registry.context_messages(queries).select("query_id", F.lit("context").alias("kind"), "body")
    answer = registry.registration_messages(queries).select("query_id", F.lit("registration").alias("kind"), "body")
    return details.unionByName(context).unionByName(answer)


@registered
def decode_requests(inputs: Inputs) -> DataFrame:
    return request_source.decode_requests(request_lines(inputs))[0]


@registered
def assign_ids(inputs: Inputs) -> DataFrame:
    return registry.assign_ids(request_source.decode_requests(request_lines(inputs))[0], inputs.queries())


# Joins


@registered
def queries_with_jobs(inputs: Inputs) -> DataFrame:
    return registry.queries_with_jobs(inputs.queries(), inputs.open_jobs()).select(
        "id", "dataset", "language"
    )


@registered
def fan_out(inputs: Inputs) -> DataFrame:
    return publish.fan_out(inputs.queries(), inputs.catalog()).select(
        "query_id", "name", "language", "md5"
    )


@registered
def merge_callbacks(inputs: Inputs) -> DataFrame:
    merged = results.merge_callbacks(inputs.open_jobs(), inputs.callbacks())
    return with_plain_outcome(merged, "query_id", "job_id", "data_id")


@registered
def unknown_callbacks(inputs: Inputs) -> DataFrame:
    nameless = inputs.callbacks().withColumn(
        "job_id", F.when(F.minute("received_at") != 7, F.col("job_id"))
    )
    return results.unknown_callbacks(nameless, inputs.open_jobs()).select(
        "job_id", "received_at", matches_text(), F.col("error.code").alias("error_code")
    )


@registered
def job_rollup(inputs: Inputs) -> DataFrame:
    return status.job_rollup(inputs.queries(), inputs.jobs())


@registered
def attach_job_ids(inputs: Inputs) -> DataFrame:
    sent = store(contexts(inputs), "contexts")
    return publish.attach_job_ids(sent, inputs.acks(sent), as_of())


@registered
def empty_acks(inputs: Inputs) -> DataFrame:
    sent = store(contexts(inputs), "contexts")
    return publish.empty_acks(inputs.acks(sent)).select("query_id", "batch_no")


@registered
def queries_without_shards(inputs: Inputs) -> DataFrame:
    return publish.queries_without_shards(inputs.queries(), inputs.catalog())


@registered
def delete_cascade(inputs: Inputs) -> DataFrame:
    queries = inputs.queries()
    pending = queries.where(F.col("status") == "pending").select(F.col("id").alias("query_id"))
    left, jobs_left = keyed.delete_queries(queries, inputs.open_jobs(), pending)
    return left.select(F.col("id").alias("query_id"), "dataset").join(
        results.result_total(jobs_left), "query_id", "full"
    )


@registered
def orphan_jobs(inputs: Inputs) -> DataFrame:
    return constraints.orphan_jobs(inputs.event_jobs(), inputs.queries())


# Aggregations


@registered
def shard_count(inputs: Inputs) -> DataFrame:
    return status.shard_count(inputs.queries(), inputs.catalog())


@registered
def dataset_stats(inputs: Inputs) -> DataFrame:
    return ingest.dataset_stats(inputs.catalog(), as_of())


@registered
def result_total(inputs: Inputs) -> DataFrame:
    return results.result_total(inputs.open_jobs())


@registered
def query_status(inputs: Inputs) -> DataFrame:
    """Only acknowledged jobs exist, so a query may have fewer than its dataset has shards."""
    sent = store(contexts(inputs), "contexts")
    created = publish.attach_job_ids(sent, inputs.acks(sent), as_of()).select("job_id")
    jobs = inputs.jobs().join(created, "job_id", "left_semi")
    return status.query_status(inputs.queries(), inputs.catalog(), jobs)


@registered
def query_counters(inputs: Inputs) -> DataFrame:
    sent = store(contexts(inputs), "contexts")
    jobs = publish.attach_job_ids(sent, inputs.acks(sent), as_of())
    return status.query_counters(inputs.queries(), sent, jobs, inputs.callbacks())


@registered
def ingest_report(inputs: Inputs) -> DataFrame:
    return ingest.ingest_report(inputs.mixed_listing(), inputs.known_catalog())


@registered
def load_report(inputs: Inputs) -> DataFrame:
    """The counts that a whole load wrote beside its tables."""
    out = new_folder(inputs, "load")
    lifecycle.refresh_catalog(
        inputs.mixed_listing(), inputs.known_catalog(), inputs.old_stats(), inputs.loads(), as_of(), out
    )
    return tables.read_table(inputs.spark, f"{out}/load_report")


@registered
def running_stats(inputs: Inputs) -> DataFrame:
    """Statistics after two loads, one of them played again before and after folding, and a delete."""
    folder = new_folder(inputs, "running")
    out, base = f"{folder}/changes", f"{folder}/base"
    known = inputs.known_catalog()
    added = store(
        keyed.rows_to_insert(known, ingest.catalog_rows(inputs.listing(), as_of()), ["md5"], [F.col("key")]), "added"
    )
    running.record_changes(out, 0, known)
    running.record_changes(out, 1, added)
    running.record_changes(out, 1, added)
    running.fold_stats(inputs.spark, out, base, 1)
    running.record_changes(out, 1, added)
    german = known.unionByName(added.select(*known.columns)).where(F.col("language") == "de")
    running.record_changes(out, 2, german.where("false"), german)
    return running.running_stats(inputs.spark, out, base, 1)


@registered
def progress(inputs: Inputs) -> DataFrame:
    return status.progress(inputs.queries(), inputs.jobs())


# Order and limit


@registered
def batch_number(inputs: Inputs) -> DataFrame:
    return contexts(inputs).select("query_id", "md5", "seq", "batch_no", "pos")


@registered
def results_page(inputs: Inputs) -> DataFrame:
    return results.build_pages(inputs.jobs(), PAGE).select(
        "query_id", "page", "pos", "job_id", "data_id", matches_text()
    )


@registered
def stable_pages(inputs: Inputs) -> DataFrame:
    """Pages after two publishes, the second of all jobs: those of the first stay where they are."""
    out, jobs = new_folder(inputs, "pages"), store(inputs.jobs(), "jobs")
    stable.append_pages(jobs.where(F.minute("finished_at") % 2 == 0), out, 0, PAGE)
    stable.append_pages(jobs, out, 1, PAGE)
    return stable.stable_pages(inputs.spark, out).select("query_id", "page", "pos", "job_id", "data_id", matches_text())


@registered
def last_key(inputs: Inputs) -> DataFrame:
    return ingest.last_key(inputs.catalog())


@registered
def last_key_overall(inputs: Inputs) -> DataFrame:
    days = F.make_dt_interval(F.pmod("byte_size", F.lit(5)).cast("int"))
    return ingest.last_key_overall(inputs.catalog().withColumn("created_at", F.col("created_at") - days))


@registered
def page_summary(inputs: Inputs) -> DataFrame:
    return results.page_summary(inputs.jobs(), PAGE)


# Keyed writes


@registered
def catalog_insert_ignore(inputs: Inputs) -> DataFrame:
    return ingest.add_to_catalog(
        inputs.known_catalog(), ingest.catalog_rows(inputs.listing(), as_of())
    )


@registered
def clustered_writes(inputs: Inputs) -> DataFrame:
    """The catalogue in clusters, after an insert-ignore, an upsert and two deletes."""
    spark, order = inputs.spark, [F.col("name")]
    table = clustered.create_clustered(inputs.known_catalog(), new_folder(inputs, "clustered"), ["md5"], 16, order)
    table = table.insert(inputs.catalog(), order)
    table = table.upsert(table.read().where("language = 'fr'").withColumn("num_of_records", F.lit(1)), order)
    table = table.delete(spark.createDataFrame([("es", "text")], "language string, data_type string"))
    table = table.delete(table.read().where("byte_size % 10 = 0").select("md5"))
    return table.read()


@registered
def stats_upsert(inputs: Inputs) -> DataFrame:
    return ingest.update_stats(inputs.old_stats(), inputs.catalog(), as_of())


@registered
def incremental_load(inputs: Inputs) -> DataFrame:
    return ingest.load_dataset(
        inputs.mixed_listing(), inputs.known_catalog(), inputs.loads(), as_of(), resume=True
    )[0]


def odd_listing(inputs: Inputs) -> DataFrame:
    """The mixed listing, with some languages too wide for the table."""
    wide = F.concat_ws("/", F.lit("src0/text/a-language-too-wide"), F.col("key"))
    return inputs.mixed_listing().select(F.when(F.col("size") % 9 == 0, wide).otherwise(F.col("key")).alias("key"), "size")


def odd_loads(inputs: Inputs) -> DataFrame:
    """Loads that cover all keys of the odd listing, short ones too."""
    pages = inputs.loads().select(F.lit("pages").alias("name"), F.lit("").alias("data_type")).distinct()
    return inputs.loads().unionByName(pages)


@registered
def load_rejects(inputs: Inputs) -> DataFrame:
    rejected = ingest.load_dataset(odd_listing(inputs), inputs.known_catalog(), odd_loads(inputs), as_of())[1]
    return rejected.select("key", "size", F.array_join("reasons", "; ").alias("reasons")).distinct()


# Constraints


@registered
def not_null_rejects(inputs: Inputs) -> DataFrame:
    rejected = constraints.check_constraints(inputs.raw_shards(), "datasets")[1]
    return rejected.select(
        "doc_id", "md5", "num_of_records", "source", F.array_join("reasons", "; ").alias("reasons")
    )


@registered
def width_rejects(inputs: Inputs) -> DataFrame:
    parts = F.split("url", "/", -1)
    shards = inputs.table("pages").select(
        "page_id",
        F.col("html").alias("name"),
        F.element_at(parts, -1).alias("language"),
        F.col("url").alias("data_type"),
        parts[2].alias("md5"),
    )
    rejected = constraints.check_constraints(shards, "datasets")[1]
    return rejected.select("page_id", F.array_join("reasons", "; ").alias("reasons"))


@registered
def status_domain_rejects(inputs: Inputs) -> DataFrame:
    rejected = constraints.check_constraints(inputs.event_jobs(), "query_results")[1]
    return rejected.select("query_id", "job_id", "status", F.array_join("reasons", "; ").alias("reasons"))


@registered
def unique_violations(inputs: Inputs) -> DataFrame:
    return constraints.unique_violations(inputs.documents(), "datasets")


# Nested values and the classifier


@registered
def explode_matches(inputs: Inputs) -> DataFrame:
    return results.explode_matches(inputs.jobs())


def label_classifier() -> Classifier:
    """Stand-in: good documents match on their non-blank lines, toxic ones fail."""

    def by_label(query_text: str, model: str, part: pd.DataFrame) -> pd.Series:
        if (part["toxic"] == 1).any():  # a label of the shard, the same in all its parts
            raise ValueError("toxic")
        return (part["quality"] == 1) & (part["text"].str.strip(" ") != "")

    return by_label


@registered
def classify_labels(inputs: Inputs) -> DataFrame:
    named = inputs.open_jobs().join(
        inputs.winners().withColumnRenamed("md5", "data_id"), "data_id"
    )
    jobs = registry.attach_context(named, inputs.queries())
    big = big_shards(inputs.documents(), "doc_id", "size", BIG)
    found = classify(jobs, inputs.labelled_shards(), label_classifier(), "doc_id", big)
    return found.select(
        "job_id",
        F.size("matches").alias("n_matches"),
        matches_text(),
        F.col("error.message").alias("error_message"),
    )


@registered
def decode_callbacks(inputs: Inputs) -> DataFrame:
    ok, _ = check_messages(decode(inputs.callback_lines()))
    return ok.select("job_id", matches_text(), F.col("error.code").alias("error_code"))


def odd_lines(inputs: Inputs) -> DataFrame:
    """The callback messages, some cut off, some without a job, some with half an error."""
    turn = F.minute("received_at") % 5
    return inputs.callback_messages().select(
        F.when(turn == 0, F.expr("substring(value, 1, length(value) - 3)"))
        .when(turn == 1, F.regexp_replace("value", '"jobId"', '"nobody"'))
        .when(turn == 2, F.lit('{"jobId":"half","errorResult":{"message":"m"}}'))
        .otherwise(F.col("value")).alias("value")
    )


@registered
def read_callbacks(inputs: Inputs) -> DataFrame:
    """All messages of a folder: taken ones with their job, others with the reasons."""
    folder = new_folder(inputs, "messages")
    odd_lines(inputs).write.text(folder)
    ok, rejected = read(inputs.spark, folder)
    taken = ok.select("job_id", F.lit("").alias("reasons"))
    return taken.unionByName(rejected.select("job_id", F.array_join("reasons", "; ").alias("reasons")))


@registered
def request_messages(inputs: Inputs) -> DataFrame:
    requests = publish.batch_requests(contexts(inputs))
    return to_wire(requests, ["data"]).select("query_id", "batch_no", "body")


@registered
def page_messages(inputs: Inputs) -> DataFrame:
    jobs = store(inputs.jobs(), "jobs")
    return results.page_messages(results.build_pages(jobs, PAGE), results.page_summary(jobs, PAGE))


# Streams, run until all files are taken


@registered
def callback_stream(inputs: Inputs) -> DataFrame:
    """Jobs after the callbacks came in as a stream of files."""
    out = streamed_callbacks(inputs, inputs.callback_lines())
    merged = streaming.jobs_with_stream(inputs.open_jobs(), out)
    return with_plain_outcome(merged, "query_id", "job_id", "data_id").withColumn(
        "finished_at", F.col("finished_at").cast("timestamp_ntz")
    )


def streamed_callbacks(inputs: Inputs, lines: DataFrame) -> str:
    """Run a stream over `lines` in several files and return where its changes are."""
    folder = new_folder(inputs, "callbacks")
    lines.repartition(4).write.text(f"{folder}/calls")
    streaming.callback_stream(
        inputs.spark, f"{folder}/calls", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=2
    ).awaitTermination()
    return f"{folder}/out"


@registered
def job_deadlines(inputs: Inputs) -> DataFrame:
    """What became of each job: settled by its last callback, or overdue a week after its creation."""
    spark, folder = inputs.spark, new_folder(inputs, "deadlines")
    inputs.open_jobs().select("job_id", F.col("created_at").cast("timestamp")).repartition(4).write.parquet(f"{folder}/jobs")
    inputs.callback_lines().repartition(4).write.text(f"{folder}/calls")
    deadlines.run_until_idle(deadlines.deadline_stream(
        spark, f"{folder}/jobs", f"{folder}/calls", f"{folder}/out", f"{folder}/checkpoint",
        timedelta(days=7), files_per_batch=2, trigger={"processingTime": "0 seconds"},
    ))
    return deadlines.job_deadlines(spark, f"{folder}/out").select(
        "job_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("deadline", "finished_at")]
    )


@registered
def stream_rejects(inputs: Inputs) -> DataFrame:
    """Messages that the stream set aside, with the reasons."""
    found = streaming.rejected_messages(inputs.spark, streamed_callbacks(inputs, odd_lines(inputs)))
    return found.select("job_id", F.array_join("reasons", "; ").alias("reasons"))


@registered
def listing_stream(inputs: Inputs) -> DataFrame:
    """Shards of the catalogue after the listing came in as a stream of files."""
    return listing_streaming.read_streamed_catalog(inputs.spark, streamed_listing(inputs)).select("md5")


@registered
def live_listing(inputs: Inputs) -> DataFrame:
    """The catalogue after objects came in two lots, with a restart of the stream between them."""
    spark, folder = inputs.spark, new_folder(inputs, "live").removeprefix("file:")
    objects = stored_objects(inputs)
    prefixes = [f"{r['source']}/" for r in objects.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("source")).distinct().collect()]
    late = F.pmod(F.xxhash64("key"), F.lit(2)) == 1
    for lot in (objects.where(~late), objects.where(late)):
        write_objects(lot, f"{folder}/objects")
        time.sleep(1)
        listing_streaming.live_listing_stream(
            spark, f"{folder}/objects", f"{folder}/catalog", f"{folder}/checkpoint", prefixes, settle=0.5
        ).awaitTermination()
    found = listing_streaming.read_streamed_catalog(spark, f"{folder}/catalog")
    return found.select("name", "language", "data_type", "md5", "byte_size")


def streamed_listing(inputs: Inputs) -> str:
    folder = new_folder(inputs, "listing")
    inputs.mixed_listing().repartition(4).write.parquet(f"{folder}/inventory")
    listing_streaming.listing_stream(
        inputs.spark, f"{folder}/inventory", f"{folder}/catalog", f"{folder}/checkpoint", files_per_batch=2
    ).awaitTermination()
    return f"{folder}/catalog"


@registered
def listing_stream_rejects(inputs: Inputs) -> DataFrame:
    """Objects that the stream set aside, with the reasons."""
    found = listing_streaming.rejected_listings(inputs.spark, streamed_listing(inputs))
    return found.select("key", "size", F.array_join("reasons", "; ").alias("reasons"))

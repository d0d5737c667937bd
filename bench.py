"""Times the headline operators and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_COPIES repeats every
document that many times under new texts (1: as given).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.durable import store
from shardlens.fixtures import Inputs, as_of
from shardlens.operators import constraints, ingest, publish, registry, results, status
from shardlens.operators.classify import big_shards, classify
from shardlens.plans.registered import label_classifier
from shardlens.sources import records

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
BATCH = 100
PAGE = 100


class Copied(Inputs):
    """Every document COPIES times, told apart by id and by a last line."""

    def table(self, name: str) -> DataFrame:
        table = super().table(name)
        if COPIES == 1 or name not in ("documents", "labels", "events"):
            return table
        key = "event_id" if name == "events" else "doc_id"
        shifted = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn(
            key, F.col(key) * COPIES + F.col("_copy")
        )
        if name == "documents":
            shifted = shifted.withColumn("text", F.concat_ws("\n", "text", F.col("_copy").cast("string")))
        return shifted.drop("_copy")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("shardlens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Copied(spark, FOLDER)

    # Inputs as stored tables, not timed. Large ones get several files, as on a cluster.
    names = ["documents", "mixed_listing", "known_catalog", "loads", "catalog", "queries",
             "open_jobs", "callbacks", "jobs", "old_stats", "labelled_shards", "winners"]
    def spread(table: DataFrame, label: str) -> DataFrame:
        large = COPIES > 1 or "text" in table.columns
        return store(table.repartition(int(CPUS)) if large else table, label)

    t = {name: spread(getattr(inputs, name)(), name) for name in names}
    contexts = spread(publish.batch_number(t["queries"], t["catalog"], BATCH), "contexts")
    acks = spread(inputs.acks(contexts), "acks")
    named = t["open_jobs"].join(t["winners"].withColumnRenamed("md5", "data_id"), "data_id")
    class_jobs = spread(registry.attach_context(named, t["queries"]), "class_jobs")

    queries = {
        "ingest": lambda: ingest.load_dataset(t["mixed_listing"], t["known_catalog"], t["loads"], as_of())[0],
        "incremental_load": lambda: ingest.load_dataset(
            t["mixed_listing"], t["known_catalog"], t["loads"], as_of(), resume=True)[0],
        "ingest_report": lambda: ingest.ingest_report(t["mixed_listing"], t["known_catalog"]),
        "stats_upsert": lambda: ingest.update_stats(t["old_stats"], t["catalog"], as_of()),
        "fan_out": lambda: publish.fan_out(t["queries"], t["catalog"]),
        "batch_requests": lambda: publish.batch_requests(
            publish.batch_number(t["queries"], t["catalog"], BATCH)),
        "attach_job_ids": lambda: publish.attach_job_ids(contexts, acks, as_of()),
        "merge_callbacks": lambda: results.merge_callbacks(t["open_jobs"], t["callbacks"]),
        "unknown_callbacks": lambda: results.unknown_callbacks(t["callbacks"], t["open_jobs"]),
        "build_pages": lambda: results.build_pages(t["jobs"], PAGE),
        "page_summary": lambda: results.page_summary(t["jobs"], PAGE),
        "query_counters": lambda: status.query_counters(
            t["queries"], contexts, t["open_jobs"], t["callbacks"]),
        "query_status": lambda: status.query_status(t["queries"], t["catalog"], t["jobs"]),
        "progress": lambda: status.progress(t["queries"], t["jobs"]),
        "orphan_jobs": lambda: constraints.orphan_jobs(t["open_jobs"], t["queries"]),
        "scan_records": lambda: records.scan_records(t["documents"]),
        "classify_big": lambda: classify(
            class_jobs, t["labelled_shards"], label_classifier(), "doc_id",
            big_shards(inputs.documents(), "doc_id", "size", 5000)),
        "page_messages": lambda: results.page_messages(
            results.build_pages(t["jobs"], PAGE), results.page_summary(t["jobs"], PAGE)),
        "classify": lambda: classify(class_jobs, t["labelled_shards"], label_classifier(), shard_key="doc_id"),
    }
    seconds = {}
    for name, query in queries.items():
        runs = []
        for _ in range(2):  # the first run warms up
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "copies": COPIES,
        "rows": {name: t[name].count() for name in ("documents", "catalog", "open_jobs", "callbacks")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()

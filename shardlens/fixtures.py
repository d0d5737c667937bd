"""Inputs of the operators, derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardlens.functions.outcomes import no_error, no_matches, outcome
from shardlens.operators.ingest import catalog_rows, dataset_stats, new_catalog
from shardlens.operators.keyed import first_per_key
from shardlens.operators.publish import fan_out
from shardlens.schemas import MATCHES, PENDING, PUBLISHED
from shardlens.sources.records import lines_of

AS_OF_TEXT = "2024-06-01 00:00:00"
EARLIER_TEXT = "2024-05-01 00:00:00"
FAILURE_CODE = 422
LATE_CODE = 503


def moment(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def as_of() -> Column:
    return moment(AS_OF_TEXT)


def label_id(label: Column) -> Column:
    """A number made from a label: its md5's first 15 hex digits."""
    return F.conv(F.substring(F.md5(label), 1, 15), 16, 10).cast("bigint")


def query_id_of(dataset: Column | str, language: Column | str) -> Column:
    dataset = F.col(dataset) if isinstance(dataset, str) else dataset
    language = F.col(language) if isinstance(language, str) else language
    return label_id(F.concat_ws("/", dataset, F.coalesce(language, F.lit("-"))))


def job_id_of(query_id: Column, md5: Column) -> Column:
    return F.md5(F.concat_ws(":", query_id.cast("string"), md5))


class Inputs:
    """Derived inputs over the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Objects and catalogue

    def documents(self) -> DataFrame:
        """Documents with the key, size and md5 of their shard."""
        key = F.concat_ws("/", "source", F.lit("text"), "lang", F.concat(F.md5("text"), F.lit(".zz")))
        return self.table("documents").select(
            "doc_id", "source", "lang", "text",
            F.md5("text").alias("md5"),
            key.alias("key"),
            F.octet_length("text").cast("bigint").alias("size"),
        )

    def listing(self) -> DataFrame:
        return self.documents().select("key", "size")

    def mixed_listing(self) -> DataFrame:
        """Shards, objects with longer keys under overlapping prefixes, and stray objects."""
        turns = self.table("conversations").select(
            F.concat_ws(
                "/",
                F.lit("chat"),
                F.when(F.col("role") == "user", "text").otherwise("text2"),
                F.lit("und"),
                F.concat(F.md5("text"), F.lit(".zz.zz")),
                F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
            ).alias("key"),
            F.octet_length("text").cast("bigint").alias("size"),
        )
        stray = self.table("pages").select(
            F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("key"),
            F.octet_length("html").cast("bigint").alias("size"),
        )
        return self.listing().unionByName(turns).unionByName(stray)

    def loads(self) -> DataFrame:
        """(name, data_type) of every load that makes up the mixed listing."""
        parts = F.split("key", "/", -1)
        return self.mixed_listing().where(F.size(parts) >= 4).select(
            parts[0].alias("name"), parts[1].alias("data_type")
        ).distinct()

    def catalog(self) -> DataFrame:
        return new_catalog(catalog_rows(self.listing(), as_of()))

    def known_catalog(self) -> DataFrame:
        """An older catalogue: shards of the labelled documents."""
        labelled = self.documents().join(self.table("labels"), "doc_id", "left_semi")
        return new_catalog(catalog_rows(labelled.select("key", "size"), moment(EARLIER_TEXT)))

    def winners(self) -> DataFrame:
        """(md5, doc_id) of the document behind each shard."""
        copies = self.documents().select("md5", "doc_id", "key")
        return first_per_key(copies, ["md5"], [F.col("key"), F.col("doc_id")]).select("md5", "doc_id")

    def old_stats(self) -> DataFrame:
        """Outdated counts of `en`, and groups that are gone by now."""
        english = dataset_stats(self.catalog(), moment(EARLIER_TEXT)).where(
            F.col("language") == "en"
        ).withColumn("total_objects", F.col("total_objects") + 1)
        gone = self.table("conversations").groupBy(
            F.lit("und").alias("language"), F.lit("chat").alias("data_type"), F.col("role").alias("name")
        ).agg(F.count("*").alias("total_objects")).withColumn("created_at", moment(EARLIER_TEXT))
        return english.unionByName(gone)

    # Queries and jobs

    def queries(self) -> DataFrame:
        """A query per dataset and language, and per dataset one without language and one without shards."""
        groups = self.table("documents").select(
            F.col("source").alias("dataset"), F.col("lang").alias("language")
        ).distinct()
        datasets = groups.select("dataset").distinct()
        wanted = groups.unionByName(
            datasets.select("dataset", F.lit(None).cast("string").alias("language"))
        ).unionByName(
            datasets.select(
                F.concat("dataset", F.lit("-gone")).alias("dataset"), F.lit("en").alias("language")
            )
        )
        number = F.col("id")
        return wanted.withColumn("id", query_id_of("dataset", "language")).select(
            "id",
            "dataset",
            "language",
            F.concat(F.lit("topic "), number.cast("string")).alias("query_text"),
            F.concat(F.lit("m"), (number % 3).cast("string")).alias("model"),
            F.concat(F.lit("u"), (number % 7).cast("string")).alias("owner"),
            F.when(number % 4 == 0, PENDING).when(number % 4 != 3, PUBLISHED).alias("status"),
            as_of().alias("created_at"),
        )

    def open_jobs(self) -> DataFrame:
        """Every query's jobs, before any callback."""
        return fan_out(self.queries(), self.catalog()).select(
            "query_id",
            F.col("md5").alias("data_id"),
            job_id_of(F.col("query_id"), F.col("md5")).alias("job_id"),
            F.lit(PENDING).alias("status"),
            as_of().alias("created_at"),
        )

    def judged_documents(self) -> DataFrame:
        """Labelled documents with the answer their label stands for.

        Toxic ones are errors, good ones match with all their lines, others have no match.
        """
        lines = F.transform(
            lines_of("text"),
            lambda line, i: F.struct(
                F.concat_ws("#", F.col("doc_id").cast("string"), i.cast("string")).alias("uri"),
                line.alias("text"),
            ),
        )
        failure = F.struct(F.lit(FAILURE_CODE).alias("code"), F.lit("toxic").alias("message"))
        arrivals = self.table("events").select(
            F.col("event_id").alias("doc_id"), F.col("ts").alias("received_at"), "event_type"
        )
        bad = F.col("toxic") == 1
        return (
            self.documents().join(self.table("labels"), "doc_id").join(arrivals, "doc_id")
            .select(
                "doc_id", "source", "lang", "md5", "received_at", "event_type",
                F.when(bad, failure).otherwise(no_error()).alias("error"),
                F.when(~bad & (F.col("quality") == 1), lines)
                .otherwise(F.array().cast(MATCHES)).alias("matches"),
            )
        )

    def jobs(self) -> DataFrame:
        """Every query's jobs with the outcome of their shard's document."""
        answers = self.judged_documents().join(self.winners().select("doc_id"), "doc_id", "left_semi")
        outcomes = answers.select(F.col("md5").alias("data_id"), outcome(F.col("received_at")).alias("o"))
        return self.open_jobs().join(outcomes, "data_id", "left").select(
            "query_id",
            "data_id",
            "job_id",
            F.coalesce("o.status", "status").alias("status"),
            F.coalesce("o.matches", no_matches()).alias("matches"),
            F.coalesce("o.error", no_error()).alias("error"),
            F.col("o.finished_at").alias("finished_at"),
            F.coalesce("o.has_payload", F.lit(False)).alias("has_payload"),
            "created_at",
        )

    def callbacks(self) -> DataFrame:
        """Callbacks for every labelled document, copies too, under its own dataset and language.

        A copy in the same dataset and language repeats its job's callback; one
        elsewhere names a job that never was. Documents with an `error` event
        fail a day later.
        """
        answers = self.judged_documents().withColumn(
            "job_id", job_id_of(query_id_of("source", "lang"), F.col("md5"))
        )
        late = F.struct(F.lit(LATE_CODE).alias("code"), F.lit("late").alias("message"))
        repeats = answers.where(F.col("event_type") == "error").select(
            "job_id",
            late.alias("error"),
            F.array().cast(MATCHES).alias("matches"),
            (F.col("received_at") + F.expr("INTERVAL 1 DAY")).alias("received_at"),
        )
        return answers.select("job_id", "error", "matches", "received_at").unionByName(repeats)

    def callback_lines(self) -> DataFrame:
        """The callbacks as the messages they arrive in, column `value`."""
        return self.callback_messages().select("value")

    def callback_messages(self) -> DataFrame:
        """The messages with the time of each callback."""
        message = F.struct(
            F.col("job_id").alias("jobId"),
            F.col("error").alias("errorResult"),
            F.col("matches").alias("batchClassifyResult"),
            F.col("received_at").cast("string").alias("receivedAt"),
        )
        return self.callbacks().select(F.to_json(message).alias("value"), "received_at")

    def acks(self, contexts: DataFrame) -> DataFrame:
        """Ids for the batches of `contexts`; every third batch of a query gets one too few."""
        ids = F.transform(
            F.sort_array(F.collect_list(F.struct("pos", job_id_of(F.col("query_id"), F.col("md5")).alias("id")))),
            lambda p: p["id"],
        )
        short = (F.col("query_id") + F.col("batch_no")) % 3 == 2
        return contexts.groupBy("query_id", "batch_no").agg(ids.alias("ids")).select(
            "query_id",
            "batch_no",
            F.when(short, F.slice("ids", F.lit(1), F.size("ids") - 1)).otherwise(F.col("ids")).alias("ids"),
        )

    # Raw rows that break rules

    def raw_shards(self) -> DataFrame:
        """Shard rows before any check: no name without a label, no language if toxic."""
        return self.documents().join(self.table("labels"), "doc_id", "left").select(
            "doc_id",
            F.when(F.col("quality").isNotNull(), F.col("source")).alias("name"),
            F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("lang")).alias("language"),
            F.lit("text").alias("data_type"),
            "md5",
            F.col("size").alias("byte_size"),
        )

    def requests(self) -> DataFrame:
        """A register request per conversation turn; some models and languages are too wide."""
        turn = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        return self.table("conversations").select(
            label_id(turn).alias("query_id"),
            F.lit("chat").alias("dataset"),
            F.concat("role", F.lit("-und")).alias("language"),
            F.col("text").alias("query_text"),
            F.col("text").alias("model"),
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("user"),
        )

    def event_jobs(self) -> DataFrame:
        """A job row per event; only events that belong to a document name a real query."""
        owners = self.table("documents").select(
            F.col("doc_id").alias("event_id"), query_id_of("source", "lang").alias("doc_query")
        )
        return self.table("events").join(owners, "event_id", "left").select(
            F.coalesce("doc_query", "user_id").alias("query_id"),
            F.col("event_id").cast("string").alias("data_id"),
            F.md5(F.col("event_id").cast("string")).alias("job_id"),
            F.when(F.col("event_type") != "signup", F.col("event_type")).alias("status"),
        )

    def labelled_shards(self) -> DataFrame:
        """Texts of all documents with their labels, if any, for a classifier that goes by label."""
        return self.documents().select("doc_id", "text").join(self.table("labels"), "doc_id", "left")

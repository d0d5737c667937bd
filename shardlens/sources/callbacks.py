"""Callbacks of the classifier, one JSON message a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.schemas import CALLBACK_WIRE, MATCHES


def decode_callbacks(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse messages to (job_id, error, matches, received_at, corrupt).

    An absent match list is an empty one. `corrupt` holds text that is no
    message of the expected types. If `lines` has `arrived_at`, it stands in
    for a missing arrival time.
    """
    message = F.from_json(
        value, CALLBACK_WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    parsed = lines.withColumn("_m", message)
    arrived = F.col("arrived_at") if "arrived_at" in lines.columns else F.lit(None)
    return parsed.select(
        F.coalesce("_m.jobId", "_m.job_id").alias("job_id"),
        F.coalesce("_m.errorResult", "_m.error_result").alias("error"),
        F.coalesce(
            "_m.batchClassifyResult", "_m.batch_classify_result", F.array().cast(MATCHES)
        ).alias("matches"),
        F.coalesce("_m.receivedAt", arrived.cast("timestamp")).alias("received_at"),
        F.when(
            F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull(), F.col(value)
        ).alias("corrupt"),
    )


def check_messages(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split decoded callbacks into (ok, rejected); rejected rows carry `reasons`."""
    sound = F.forall("matches", lambda m: m["uri"].isNotNull() & m["text"].isNotNull())
    reasons = F.filter(
        F.array(
            F.when(F.col("corrupt").isNotNull(), "not a callback message"),
            F.when(F.col("corrupt").isNull() & F.col("job_id").isNull(), "job_id is missing"),
            F.when(F.col("error").isNotNull() & F.col("error.code").isNull(), "error code is missing"),
            F.when(~sound, "uri or text of a match is missing"),
        ),
        lambda r: r.isNotNull(),
    )
    checked = decoded.withColumn("reasons", reasons)
    ok = checked.where(F.size("reasons") == 0).drop("reasons", "corrupt")
    return ok, checked.where(F.size("reasons") > 0)


def read_callbacks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Callbacks below `path` as (ok, rejected)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("arrived_at")
    )
    return check_messages(decode_callbacks(lines))


def stream_callbacks(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same feed as a stream of decoded messages."""
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
        .select("value", F.col("_metadata.file_modification_time").alias("arrived_at"))
    )
    return decode_callbacks(lines)

"""Register requests and publish acks, one JSON message a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shardlens.schemas import ACK_WIRE, REQUEST_WIRE

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _split_by(parsed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    corrupt = F.col("corrupt").isNotNull()
    missing = [F.when(~corrupt & F.col(c).isNull(), f"{c} is missing") for c in required]
    reasons = F.array_compact(F.array(F.when(corrupt, "not a message of this kind"), *missing))
    checked = parsed.withColumn("reasons", reasons)
    ok = checked.where(F.size("reasons") == 0).drop("reasons", "corrupt")
    return ok, checked.where(F.size("reasons") > 0)


def _corrupt(value: str):
    broken = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull()
    return F.when(broken, F.col(value)).alias("corrupt")


def decode_requests(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Register requests as (ok, rejected). All five fields are required."""
    parsed = lines.withColumn("_m", F.from_json(value, REQUEST_WIRE, _OPTIONS)).select(
        "_m.dataset",
        "_m.language",
        F.coalesce("_m.queryText", "_m.query_text").alias("query_text"),
        "_m.model",
        "_m.user",
        _corrupt(value),
    )
    return _split_by(parsed, ["dataset", "language", "query_text", "model", "user"])


def decode_acks(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Acks (query_id, batch_no, ids) as (ok, rejected). An ack without ids is a rejected one."""
    parsed = lines.withColumn("_m", F.from_json(value, ACK_WIRE, _OPTIONS)).select(
        "_m.query_id",
        "_m.batch_no",
        F.when(F.size("_m.ids") > 0, F.col("_m.ids")).alias("ids"),
        _corrupt(value),
    )
    return _split_by(parsed, ["query_id", "batch_no", "ids"])

"""Column expressions for the outcome of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardlens.schemas import ERROR, FAILURE, MATCHES, PROCESSED

OUTCOME_FIELDS = ["matches", "error", "status", "finished_at", "has_payload"]


def no_matches() -> Column:
    return F.lit(None).cast(MATCHES)


def no_error() -> Column:
    return F.lit(None).cast(FAILURE)


def has_matches(matches: str = "matches") -> Column:
    """An empty match list counts as none."""
    return F.coalesce(F.size(matches) > 0, F.lit(False))


def outcome(finished_at: Column, matches: str = "matches", error: str = "error") -> Column:
    """What a callback leaves on its job, as one struct.

    The payload is the matches, else the error. Any error makes the status
    `error`, also beside matches. `has_payload` says whether there is one, so
    that counts need not read it.
    """
    found = has_matches(matches)
    return F.struct(
        F.when(found, F.col(matches)).alias("matches"),
        F.when(~found, F.col(error)).alias("error"),
        F.when(F.col(error).isNotNull(), ERROR).otherwise(PROCESSED).alias("status"),
        finished_at.alias("finished_at"),
        (found | F.col(error).isNotNull()).alias("has_payload"),
    )


def is_visible(jobs: DataFrame) -> Column:
    """Jobs shown on result pages: processed, with a payload. Snapshots without the flag are asked for the payload."""
    if "has_payload" in jobs.columns:
        payload = F.col("has_payload")
    else:
        payload = F.col("matches").isNotNull() | F.col("error").isNotNull()
    return (F.col("status") == PROCESSED) & payload

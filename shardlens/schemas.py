"""Column types, table rules and fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Sizes and words that must agree with the service being served.
BATCH_SIZE = 1000
PAGE_SIZE = 1000
KEY_SEPARATOR = "/"
KEY_SUFFIX = ".zz"
UNKNOWN_LANGUAGE = "unknown"
RECORD_LANGUAGE = "en"
PENDING, PUBLISHING, PUBLISHED, PROCESSED, ERROR = (
    "pending", "publishing", "published", "processed", "error",
)
QUERY_STATUSES = [PENDING, PUBLISHING, PUBLISHED, PROCESSED]
JOB_STATUSES = [PENDING, PROCESSED, ERROR]

MATCH = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("text", T.StringType()),
])
MATCHES = T.ArrayType(MATCH)
FAILURE = T.StructType([
    T.StructField("code", T.IntegerType()),
    T.StructField("message", T.StringType()),
])

LISTING = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("size", T.LongType()),
])

# A callback as it comes over the wire. Field names are accepted in camel case
# and in snake case; `receivedAt` is optional and stands for the arrival time.
CALLBACK_WIRE = T.StructType([
    T.StructField("jobId", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("errorResult", FAILURE),
    T.StructField("error_result", FAILURE),
    T.StructField("batchClassifyResult", MATCHES),
    T.StructField("batch_classify_result", MATCHES),
    T.StructField("receivedAt", T.TimestampType()),
    T.StructField("_corrupt_record", T.StringType()),
])

REQUEST_WIRE = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("queryText", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# An answer to one batch, with the keys its request was written under.
ACK_WIRE = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("batch_no", T.LongType()),
    T.StructField("ids", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])


@dataclass(frozen=True)
class Rule:
    """What one column of a stored table must satisfy."""

    column: str
    type: str
    required: bool = False
    default: object = None
    width: int | None = None
    allowed: tuple[str, ...] | None = None


# Nullability, defaults, widths and status words of the stored tables.
TABLE_RULES: dict[str, list[Rule]] = {
    "datasets": [
        Rule("name", "string", required=True, width=255),
        Rule("language", "string", required=True, default=UNKNOWN_LANGUAGE, width=10),
        Rule("data_type", "string", required=True, width=50),
        Rule("md5", "string", required=True, width=32),
        Rule("num_of_records", "int", default=0),
        Rule("decompressed_byte_size", "bigint", default=0),
        Rule("byte_size", "bigint", default=0),
        Rule("source", "string", default=""),
    ],
    "queries": [
        Rule("dataset", "string", required=True, width=255),
        Rule("language", "string", width=10),
        Rule("query_text", "string", required=True),
        Rule("model", "string", required=True, width=255),
        Rule("owner", "string", required=True, width=255),
        Rule("status", "string", default=PENDING, width=20, allowed=tuple(QUERY_STATUSES)),
    ],
    "query_results": [
        Rule("query_id", "bigint", required=True),
        Rule("data_id", "string", required=True),
        Rule("job_id", "string", required=True, width=255),
        Rule("status", "string", default=PENDING, width=20, allowed=tuple(JOB_STATUSES)),
    ],
    "dataset_stats": [
        Rule("name", "string", required=True, width=255),
        Rule("language", "string", required=True, width=10),
        Rule("data_type", "string", required=True, width=50),
        Rule("total_objects", "bigint", default=0),
    ],
}

UNIQUE_KEYS = {
    "datasets": ["md5"],
    "query_results": ["job_id"],
    "dataset_stats": ["language", "data_type", "name"],
}

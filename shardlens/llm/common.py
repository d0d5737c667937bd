"""What the operators share: row identity, batches of texts, sizing."""

from __future__ import annotations

import ctypes
import ctypes.util
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spaces and controls that part words, as a class of Java and Python patterns.
BLANK = r"\x20\x09-\x0D"
# Stands for a missing doc_id: such rows are one document that comes last.
LAST_ID = (1 << 63) - 1
# Rows of an output batch, about.
OUT_ROWS = 1 << 14
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def row_id(column: str = "doc_id") -> Column:
    """doc_id as a key that joins; null becomes the last of all ids."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def back_to_doc_id(column: str = "_id") -> Column:
    return F.nullif(F.col(column), F.lit(LAST_ID))


def texts(docs: DataFrame) -> DataFrame:
    """(_id, text) of every row; a null text is an empty one. Other columns are not read."""
    return docs.select(row_id().alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def rows_of(batch: pa.RecordBatch, *names: str, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, of which only `step` at a time are Python values."""
    for low in range(0, batch.num_rows, step):
        yield from zip(*columns_of(batch.slice(low, step), *names))


def map_rows(
    df: DataFrame, schema: str, setup: Callable[[], Callable[..., Iterable[tuple]]], *names: str
) -> DataFrame:
    """Map the rows of `df` in Arrow batches.

    `setup` runs once a task (it loads a vocabulary, say) and returns a function
    that gets the values of `names` and yields output tuples.
    """
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            rows = []
            for values in rows_of(batch, *names):
                rows += work(*values)
                if len(rows) >= OUT_ROWS:
                    yield to_batch(rows, fields)
                    rows = []
            yield to_batch(rows, fields)
        work = rows = batch = values = None
        give_back_memory()

    return df.select(*names).mapInArrow(run, schema)


def _at_most(spark: SparkSession, rows: int) -> str:
    """So many rows a batch, or fewer if the session has set fewer."""
    before = spark.conf.get(BATCH_ROWS, None)
    return str(min(rows, int(before)) if before and int(before) > 0 else rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run in here hand at most `rows` rows at a time to Python, however the session is set."""
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, _at_most(spark, rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, before)


def in_small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """`df` in a session of its own, in which Python gets at most `rows` rows at a time.

    For results that run later, when `small_batches` has ended: a batch of whole texts is held by
    the executor and by its worker at once. What is set in `df`'s session now is set there too, and
    that session stays as it is. Nothing runs here.
    """
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            with suppress(AnalysisException):  # of the whole application, so it holds there as it is
                own.conf.set(key, value)
    own.conf.set(BATCH_ROWS, _at_most(spark, rows))
    name = f"_llm_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gave to the first task of this worker process that asked for `key`.

    For memories of bounded size that hold nothing of a task. Functions reach the workers by
    value, so a module of theirs would not outlive a task.
    """
    held = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back_memory() -> None:
    """Hand freed memory back to the machine: workers live on between stages, and their memory with them."""
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None
    if trim:
        trim(0)


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with `_llm_text` as text, and n_chars, if there is one, counted anew."""
    new = {"text": F.col("_llm_text"), "n_chars": F.length("_llm_text").cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def to_batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.record_batch(
        [pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields
    )


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return _arrow_schema(spark, schema)

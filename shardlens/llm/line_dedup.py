"""Line dedup that can be taken back.

The state is a table of holdings (which document holds which line key), the
exact reference counts of keys (how many documents hold it, the smallest of
them), and one cuckoo filter a shard of keys. A batch of documents asks the
filters first: keys they have not seen are new for certain, and only the rest
meets the count table. Deleting documents lowers counts, finds the next
smallest holder from the holdings, and takes keys that nobody holds out of the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardlens.durable import store
from shardlens.llm.common import arrow_schema, back_to_doc_id, map_rows, row_id, texts, to_batch, with_text

MIN_CHARS = 10
STRIPPED = b"\t\n\x0b\x0c\r "
KEY_BYTES = 16
# Keys of one shard, and so of one filter and one task's group.
SHARD_KEYS = 1 << 14

SLOTS = 4
MAX_KICKS = 500
# Share of slots in use that a new filter is made for, and above which it is made anew.
LOAD = 0.75
FULL = 0.9

HOLDING = "key binary, _id bigint"
LINES = "_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
FILTER = "shard int, buckets int, slots binary"


def line_key(line: bytes) -> bytes:
    """A line stripped of ASCII blanks, with A-Z in lower case."""
    return line.strip(STRIPPED).lower()


def is_long(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


class CuckooFilter:
    """A set of 64-bit values with deletion: 4 slots a bucket, 16-bit marks, 0 is free.

    A value has two buckets; each follows from the other and the mark, so marks
    can move without the value. Answers "absent" are certain. A mark may stand
    several times, once for each value inserted with it. Values must not be inserted twice and only
    inserted ones deleted; the count tables see to that.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def for_values(cls, n: int) -> CuckooFilter:
        need = max(1, int(n / (SLOTS * LOAD)) + 1)
        return cls(1 << (need - 1).bit_length())

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = ((values >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (values & np.uint64(self.buckets - 1)).astype(np.int64)
        return marks, first, first ^ self._jump(marks)

    def _jump(self, marks: np.ndarray) -> np.ndarray:
        """Odd, so that a value's two buckets differ wherever there are two."""
        far = marks.astype(np.uint64) * np.uint64(0x5BD1E995) | np.uint64(1)
        return (far & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, values: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(values)
        mark = marks[:, None]
        return (self.slots[first] == mark).any(1) | (self.slots[second] == mark).any(1)

    def insert(self, values: np.ndarray) -> CuckooFilter:
        """Insert all values and return this filter. An OverflowError leaves it unusable."""
        marks, first, second = self.places(values)
        # Rounds of free slots for many values at once; the few that are left are moved one by one.
        waiting = np.arange(len(values))
        for place in (first, second) * SLOTS:
            if not len(waiting):
                break
            at = place[waiting]
            free = np.argmax(self.slots[at] == 0, axis=1)
            room = self.slots[at, free] == 0
            where = at * SLOTS + free
            _, once = np.unique(where, return_index=True)
            lucky = np.zeros(len(waiting), bool)
            lucky[once] = True
            lucky &= room
            self.slots[at[lucky], free[lucky]] = marks[waiting[lucky]]
            waiting = waiting[~lucky]
        random = np.random.default_rng(len(values))
        for i in waiting.tolist():
            self._insert_one(int(marks[i]), int(first[i]), random)
        return self

    def _insert_one(self, mark: int, at: int, random: np.random.Generator) -> None:
        for _ in range(MAX_KICKS):
            for place in (at, at ^ int(self._jump(np.array([mark], np.uint16))[0])):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = mark
                    return
                at = place
            slot = int(random.integers(SLOTS))
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at ^= int(self._jump(np.array([mark], np.uint16))[0])
        raise OverflowError("the filter is full")

    def take(self, values: np.ndarray) -> bool:
        """Insert all values if there is room; otherwise this filter is of no more use."""
        if np.count_nonzero(self.slots) + len(values) > FULL * self.slots.size:
            return False
        try:
            self.insert(values)
        except OverflowError:
            return False
        return True

    @classmethod
    def holding(cls, values: np.ndarray) -> CuckooFilter:
        """A filter of these values with room for as many more."""
        found = cls.for_values(2 * len(values))
        while not found.take(values):
            found = cls(2 * found.buckets)
        return found

    def delete(self, values: np.ndarray) -> None:
        for mark, first, second in zip(*(a.tolist() for a in self.places(values))):
            for place in (first, second):
                held = np.flatnonzero(self.slots[place] == mark)
                if len(held):
                    self.slots[place, held[0]] = 0
                    break

    def to_row(self, shard: int) -> tuple[int, int, bytes]:
        return shard, self.buckets, self.slots.tobytes()

    @classmethod
    def from_row(cls, buckets: int, slots: bytes) -> CuckooFilter:
        return cls(buckets, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())


def values_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8").astype(np.uint64)


def shard_of(shards: int):
    """The shard of a key: bytes that neither marks nor buckets of the filter use."""
    return F.pmod(F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


@dataclass
class LineStore:
    """Holdings (key, _id), counts (shard, key, n, first) and filters (shard, buckets, slots), all stored tables."""

    holdings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def holdings_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, _id): the distinct keys of each row, by their digests."""

    def setup() -> Callable:
        def keys(doc_id: int, text: str) -> Iterator[tuple]:
            distinct = {line_key(line) for line in text.encode().split(b"\n")}
            return [(digest(k), doc_id) for k in distinct if is_long(k, min_chars)]

        return keys

    return map_rows(texts(docs), HOLDING, setup, "_id", "text")


def count_holdings(holdings: DataFrame, unique_ids: bool = False) -> DataFrame:
    """(key, n, first). Partial sums first, so a key that many documents hold is not one task's work.

    Rows that share a doc_id are one document; unless ids are known to be
    unique, its keys are made distinct first.
    """
    rows = holdings if unique_ids else holdings.distinct()
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("_id").alias("first"))


def empty_store(spark, shards: int) -> LineStore:
    counts = spark.createDataFrame([], "shard int, key binary, n bigint, first bigint")
    return LineStore(
        spark.createDataFrame([], HOLDING), counts, spark.createDataFrame([], FILTER), shards
    )


def _with_filters(keys: DataFrame, filters: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`work(table of keys, filter row or None)` for each shard; a shard's keys are bounded by SHARD_KEYS or so."""
    fields = arrow_schema(keys.sparkSession, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = work(left, right.to_pylist()[0] if right.num_rows else None)
        return pa.Table.from_batches([to_batch(rows, fields)])

    # Both sides may come from one table; named anew, their columns are told apart.
    own = filters.select(*[F.col(c).alias(c) for c in filters.columns])
    return keys.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(run, schema)


def insert_documents(state: LineStore, docs: DataFrame, unique_ids: bool = False) -> LineStore:
    """The state with more documents, which must not be in it yet."""
    held = store(holdings_of(docs), "holdings")
    batch = store(count_holdings(held, unique_ids).withColumn("shard", shard_of(state.shards)), "batch_counts")

    def probe(left: pa.Table, row: dict | None) -> list[tuple]:
        """New keys go into the filter; the filter itself leaves as a row without key."""
        keys = left.column("key").to_pylist()
        if not keys:
            return [(row["shard"], None, None, None, True, row["buckets"], row["slots"])] if row else []
        shard = left.column("shard")[0].as_py()
        values = values_of(keys)
        filter_ = CuckooFilter.from_row(row["buckets"], row["slots"]) if row else None
        seen = filter_.contains(values) if filter_ else np.zeros(len(keys), bool)
        fresh = values[~seen]
        out = [
            (shard, k, n, first, bool(s), None, None)
            for k, n, first, s in zip(keys, left.column("n").to_pylist(), left.column("first").to_pylist(), seen.tolist())
        ]
        if filter_ is None:
            filter_ = CuckooFilter.holding(fresh)
            out.append((shard, None, None, None, False, *filter_.to_row(shard)[1:]))
            return out
        if filter_.take(fresh):
            out.append((shard, None, None, None, False, *filter_.to_row(shard)[1:]))
        return out

    schema = "shard int, key binary, n bigint, first bigint, seen boolean, buckets int, slots binary"
    probed = store(_with_filters(batch, state.filters, probe, schema), "probed")
    keys = probed.where("key is not null").select("shard", "key", "n", "first", "seen")
    fresh, maybe = keys.where("not seen").drop("seen"), keys.where("seen").drop("seen")
    # Only what the filters may have seen meets the exact counts.
    merged = (
        state.counts.unionByName(maybe).groupBy("shard", "key")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ) if not _is_empty(state.counts) else maybe
    counts = store(merged.unionByName(fresh), "counts")
    kept = probed.where("slots is not null").select("shard", "buckets", "slots")
    # False positives of the filter are new keys as well: they go in now. A full filter is built anew from the counts.
    missing = maybe.join(state.counts.select("key"), "key", "left_anti") if not _is_empty(state.counts) else maybe
    filters = store(_filled(missing, counts, kept), "filters")
    # Both are stored; a long-lived state may be written anew as one table now and then.
    holdings = held if _is_empty(state.holdings) else state.holdings.unionByName(held)
    return LineStore(holdings, counts, filters, state.shards)


def _is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def _filled(missing: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Filters with the keys `missing` inserted; shards whose filter is full or absent get one of all their keys."""
    def add(left: pa.Table, row: dict | None) -> list[tuple]:
        keys = left.column("key").to_pylist()
        if row is None:
            return []
        filter_ = CuckooFilter.from_row(row["buckets"], row["slots"])
        return [filter_.to_row(row["shard"])] if filter_.take(values_of(keys)) else []

    def build(left: pa.Table, _: dict | None) -> list[tuple]:
        filter_ = CuckooFilter.holding(values_of(left.column("key").to_pylist()))
        return [filter_.to_row(left.column("shard")[0].as_py())]

    grown = store(_with_filters(missing.select("shard", "key"), kept, add, FILTER), "filters")
    present = grown.select(F.col("shard").alias("_present"))
    absent = counts.select("shard", "key").join(present, F.col("shard") == F.col("_present"), "left_anti")
    return grown.unionByName(_with_filters(absent, kept.limit(0), build, FILTER))


def delete_documents(state: LineStore, ids: DataFrame) -> LineStore:
    """The state without the documents `_id` of `ids`, as if they had never been inserted."""
    gone = store(state.holdings.join(ids.select("_id").distinct(), "_id", "left_semi").distinct(), "gone")
    left = store(state.holdings.join(ids.select("_id").distinct(), "_id", "left_anti"), "holdings")
    lost = gone.groupBy("key").agg(F.count("*").alias("_lost"), F.min("_id").alias("_was"))
    touched = left.join(gone.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("_id").alias("_now"))
    counts = store(
        state.counts.join(lost, "key", "left").join(touched, "key", "left").select(
            "shard", "key", (F.col("n") - F.coalesce("_lost", F.lit(0))).alias("n"),
            F.when(F.col("_lost").isNull(), F.col("first")).otherwise(F.col("_now")).alias("first"),
        ),
        "counts",
    )
    zero = counts.where("n = 0").select("shard", "key")

    def drop(keys: pa.Table, row: dict | None) -> list[tuple]:
        filter_ = CuckooFilter.from_row(row["buckets"], row["slots"])
        found = keys.column("key").to_pylist()
        if found:
            filter_.delete(values_of(found))
        return [filter_.to_row(row["shard"])]

    filters = store(_with_filters(zero, state.filters, drop, FILTER), "filters")
    return LineStore(left, counts.where("n > 0"), filters, state.shards)


def shards_for(docs: DataFrame) -> int:
    """Shards by the size of all texts: lines of 64 bytes would fill them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + int(size) // (64 * SHARD_KEYS)


def drops(state: LineStore) -> DataFrame:
    """(_id, _llm_keys): for each document, the keys whose lines it loses to a smaller doc_id."""
    shared = state.counts.where("n > 1").select("key", "first")
    return (
        state.holdings.join(shared, "key")
        .where(F.col("_id") != F.col("first"))
        .groupBy("_id").agg(F.collect_set("key").alias("_llm_keys"))
    )


def kept_lines(text: str | None, dropped: list[bytes] | None, min_chars: int = MIN_CHARS) -> tuple[int, int, bytes]:
    """Number of lines, of dropped lines, and what is left."""
    lines = (text or "").encode().split(b"\n")
    if dropped is None or not len(dropped):
        return len(lines), 0, b"\n".join(lines)
    gone = set(dropped)
    kept = []
    for line in lines:
        key = line_key(line)
        if not (is_long(key, min_chars) and digest(key) in gone):
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def store_of(docs: DataFrame, insertions: int = 1) -> LineStore:
    """The state that holds exactly `docs`, inserted in so many batches of whole documents.

    From the second batch on, the filters tell which of its keys must meet the counts.
    """
    unique = docs.groupBy(row_id().alias("_id")).count().where("count > 1").isEmpty()
    state = empty_store(docs.sparkSession, shards_for(docs))
    for batch in range(insertions):
        part = docs if insertions == 1 else docs.where(F.pmod(F.xxhash64(row_id()), F.lit(insertions)) == batch)
        state = insert_documents(state, part, unique)
    return state


def deduplicated(docs: DataFrame, state: LineStore) -> DataFrame:
    """`docs` with each text reduced to the lines that no smaller doc_id holds.

    Null texts stay null, a text that loses all its lines becomes ''. Other
    columns stay as they are. Rows sharing a doc_id are one document.
    """
    @F.pandas_udf("string")
    def reduced(text: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None or d is None else kept_lines(t, list(d))[2].decode() for t, d in zip(text, dropped)
        ], dtype=object)

    lost = drops(state).withColumnRenamed("_id", "_llm_id")
    met = docs.join(lost, row_id() == F.col("_llm_id"), "left")
    return with_text(met.withColumn("_llm_text", reduced("text", "_llm_keys")), docs.columns)


def line_digests(docs: DataFrame, state: LineStore) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row; a null or empty text is one empty line."""

    def setup() -> Callable:
        def digests(doc_id: int, text: str, dropped: list[bytes] | None) -> list[tuple]:
            lines, gone, kept = kept_lines(text, dropped)
            return [(doc_id, lines, gone, hashlib.sha256(kept).hexdigest())]

        return digests

    met = texts(docs).join(drops(state), "_id", "left")
    found = map_rows(met, LINES, setup, "_id", "text", "_llm_keys")
    return found.select(back_to_doc_id().alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")

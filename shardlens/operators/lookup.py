"""Joins of many rows with a control table that is usually small.

Queries, loads and reject lists are small next to shards and jobs, and one of
their keys may match a third of all rows. Below a measured size the control
table is broadcast and the many rows stay where they are. Above it, a sketch of
the join keys finds the hot ones; rows of these are spread over as many salts as
their number asks for, and only their control rows are repeated, once a salt. Both
ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 << 20
SALTS = 64
# A key is spread over so many tasks at most.
MOST_SALTS = 1024
# A key is hot with so many times the rows of an even task.
HOT = 4
# Keys that a sketch tracks, those that are read from it, and sketches that are merged at first.
TRACKED, READ, SKETCHES = 4096, 1024, 64
_ROW_OVERHEAD = 64
# Bits of a filter for each key, its bits at most, those of a bucket as Spark builds them, and of a range as it is sent.
BITS_A_KEY, MOST_BITS, BUCKET_BITS, RANGE_BITS = 16, 1 << 27, 1 << 15, 1 << 9
_SALT, _KEY = "_salt", "_key_hash"


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as text plus an overhead per row. Runs one aggregate."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(_ROW_OVERHEAD)
    return df.agg(F.sum(row.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def with_possible(rows: DataFrame, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """`rows` with `_may`: whether `keys` may hold their key. False is certain; true is right but for a few.

    A Bloom filter with one hash: tasks set the bits of their keys, range by range of hashes, and a broadcast of
    the ranges (16 MB of bits at most, whatever the number of keys) meets the rows where they are.
    """
    if bits is None:
        bits = min(MOST_BITS, BITS_A_KEY * keys.count() + 1)
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    # Buckets of 32,768 bits, of which only ranges that hold a key are sent.
    marked = keys.select((place + 1).alias("_at")).groupBy(F.expr("bitmap_bucket_number(_at) - 1").alias("_bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bits")
    )
    each = BUCKET_BITS // RANGE_BITS
    ranges = marked.select("_bucket", "_bits", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_nth")).select(
        (F.col("_bucket") * each + F.col("_nth")).alias("_range"),
        F.expr(f"substring(_bits, _nth * {RANGE_BITS // 8} + 1, {RANGE_BITS // 8})").alias("_bits"),
    ).where(F.bit_length(F.expr("trim(TRAILING X'00' FROM _bits)")) > 0)
    placed = rows.withColumn("_place", place).withColumn("_range", F.expr(f"_place div {RANGE_BITS}"))
    octet = F.conv(F.hex(F.expr(f"substring(_bits, cast(_place % {RANGE_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        placed.join(F.broadcast(ranges), "_range", "left")
        .withColumn("_may", F.coalesce(F.getbit(octet, (F.col("_place") % 8).cast("int")) == 1, F.lit(False)))
        .drop("_range", "_place", "_bits")
    )


def without_keys(table: DataFrame, keys: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `table` whose key `keys` (its columns) does not hold. Only possible hits of a large update are shuffled.

    Evaluates `keys` more than once, so hand in a stored frame.
    """
    if measured_bytes(keys) <= broadcast_bytes:
        return table.join(F.broadcast(keys), keys.columns, "left_anti").select(*table.columns)
    marked = with_possible(table, keys)
    hits = marked.where("_may").join(keys, keys.columns, "left_anti")
    return marked.where("NOT _may").select(*table.columns).unionByName(hits.select(*table.columns))


def known_keys(keys: DataFrame, table: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those rows of `keys` that occur in `table` (which has the same columns and more).

    A few keys are broadcast to the table, which then is scanned but not
    shuffled; of many, a filter is, and only rows that pass it are shuffled. Evaluates `keys` twice, so hand in a stored frame.
    """
    candidates = table.select(*keys.columns)
    if measured_bytes(keys) <= broadcast_bytes:
        return candidates.join(F.broadcast(keys), keys.columns, "left_semi").distinct()
    hits = with_possible(candidates, keys).where("_may")
    return keys.join(hits, keys.columns, "left_semi")


def rows_with_keys(table: DataFrame, keys: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `table` whose key `keys` (its columns) holds. Of a large table only possible hits are shuffled.

    Evaluates `keys` more than once, so hand in a stored frame.
    """
    if measured_bytes(keys) <= broadcast_bytes:
        return table.join(F.broadcast(keys), keys.columns, "left_semi").select(*table.columns)
    hits = with_possible(table, keys).where("_may").join(keys, keys.columns, "left_semi")
    return hits.select(*table.columns)


def hot_keys(rows: DataFrame, on: list[str], salts: int = MOST_SALTS) -> list[tuple[int, int]]:
    """(hash, salts) of the join keys that hold far more rows than an even task.

    Every task sketches the keys of its rows (the most frequent of bounded number),
    the sketches are merged in two steps, and the driver gets the READ largest. A key that is not
    among them has less than one in READ of all rows and needs no salts. Counts are close estimates; they
    decide how rows are dealt out, never which rows there are.
    """
    keys = rows.select(F.xxhash64(*on).alias(_KEY), F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("_part"))
    sketches = keys.groupBy("_part").agg(
        F.expr(f"approx_top_k_accumulate({_KEY}, {TRACKED})").alias("sketch"), F.count("*").alias("n")
    )
    merged = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {READ})")
    # By a key, as tasks without a sketch have none to merge.
    found = sketches.groupBy((F.col("_part") * 0).alias("_all")).agg(merged.alias("top"), F.sum("n").alias("n")).first()
    if found is None:
        return []
    even = max(1, found["n"] / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [(r["item"], min(salts, max(1, round(r["count"] / even)))) for r in found["top"] if r["count"] > HOT * even]


def lookup_join(
    rows: DataFrame,
    control: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = MOST_SALTS,
) -> DataFrame:
    """Join `rows` with `control` on `on`; `how` keeps or drops rows of the left side.

    `spread_by` are columns of `rows` that vary within one join key. Beyond
    `broadcast_bytes` of control rows, `rows` is read once more for its hot keys, which
    are spread over up to `salts` tasks; rows of all other keys and their control rows stay as they are.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat rows of a salted control table")
    if measured_bytes(control) <= broadcast_bytes:
        return rows.join(F.broadcast(control), on, how)
    hot = hot_keys(rows, on, salts)
    if not hot:
        return rows.join(control, on, how)
    # READ rows at most.
    marks = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{_KEY} bigint, _salts int"))
    many = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread_by), many).cast("int")
    salted_rows = rows.withColumn(_KEY, F.xxhash64(*on)).join(marks, _KEY, "left").withColumn(_SALT, salt).drop(_KEY, "_salts")
    salted_control = (
        control.withColumn(_KEY, F.xxhash64(*on)).join(marks, _KEY, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), many - 1))).drop(_KEY, "_salts")
    )
    return salted_rows.join(salted_control, [*on, _SALT], how).drop(_SALT)

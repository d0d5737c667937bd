"""Exact row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shardlens.durable import store

# monotonically_increasing_id puts the partition above these bits and the row below.
_ROW_BITS = 33


def number_rows(
    df: DataFrame, groups: list[str], order: list[str], name: str = "seq"
) -> DataFrame:
    """Add the 0-based position of each row within its group, by `order`.

    `order` must be total within a group. A window would sort a whole group in
    one task; here the table is range-sorted, so a large group is cut into
    several partitions, and is stored with each row's place. A group then is a
    series of runs, one per partition it touches, and a row's number is the
    length of the earlier runs plus its place in its own. There are at most
    (groups + partitions) runs. The stored table also is in group order, so
    reads of one group skip all other files.
    """
    placed = df.sort(*groups, *order).withColumn("_place", F.monotonically_increasing_id())
    stored = store(placed, "numbered").withColumn("_part", F.shiftright("_place", _ROW_BITS))
    runs = stored.groupBy(*groups, "_part").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_length")
    )
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = store(
        runs.select(
            *groups,
            "_part",
            (F.coalesce(F.sum("_length").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "offsets",
    )
    same_run = [stored[c].eqNullSafe(offsets[c]) for c in [*groups, "_part"]]
    return stored.join(offsets, same_run).select(
        *[stored[c] for c in df.columns], (stored["_place"] + offsets["_shift"]).alias(name)
    )

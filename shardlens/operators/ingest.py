"""From an object listing to the catalogue of shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from shardlens.durable import store
from shardlens.functions.keys import is_valid_key, key_fields, key_part, load_prefix, object_key
from shardlens.operators.constraints import broken_rules, check_constraints, keeps_rules
from shardlens.operators.keyed import first_per_key, insert_ignore, rows_to_insert, upsert
from shardlens.operators.lookup import lookup_join
from shardlens.schemas import RECORD_LANGUAGE

CATALOG_COLUMNS = [
    "name", "language", "data_type", "md5", "num_of_records",
    "decompressed_byte_size", "byte_size", "source", "created_at",
]
STATS_KEYS = ["language", "data_type", "name"]


def split_valid(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing rows whose key can be parsed, and those whose key cannot."""
    valid = is_valid_key("key")
    return listing.where(valid), listing.where(~valid)


def parse_keys(listing: DataFrame) -> DataFrame:
    """Add name, data_type, language and md5 to valid listing rows."""
    return listing.select("*", *key_fields("key"))


def list_prefix(listing: DataFrame, name: str, data_type: str, start_after: str = "") -> DataFrame:
    """One load's part of a listing; `start_after` is exclusive. Both filters push down."""
    return listing.where(
        F.col("key").startswith(f"{name}/{data_type}") & (F.col("key") > F.lit(start_after))
    )


def list_loads(listing: DataFrame, loads: DataFrame) -> DataFrame:
    """The listings of many loads at once.

    `loads` has name, data_type and optionally start_after. A prefix holds the
    whole name, so loads are matched by name first and by prefix after that.
    An object is listed once for every load whose prefix covers it.
    """
    wanted = loads.select(
        F.col("name").alias("load_name"),
        F.col("data_type").alias("load_type"),
        (F.col("start_after") if "start_after" in loads.columns else F.lit("")).alias("_after"),
        key_part("name", 1).alias("_head"),
    )
    headed = listing.withColumn("_head", key_part("key", 1))
    return (
        lookup_join(headed, wanted, ["_head"], ["key"])
        .where(
            F.col("key").startswith(load_prefix("load_name", "load_type"))
            & (F.col("key") > F.coalesce("_after", F.lit("")))
        )
        .select("load_name", "load_type", *listing.columns)
    )


def catalog_rows(listing: DataFrame, as_of: Column) -> DataFrame:
    """Catalogue rows of a listing, with its `key`: counts unknown, size as listed."""
    valid, _ = split_valid(listing)
    return parse_keys(valid).select(
        "key",
        "name",
        "language",
        "data_type",
        "md5",
        F.lit(0).alias("num_of_records"),
        F.lit(0).cast("bigint").alias("decompressed_byte_size"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("byte_size"),
        F.lit("").alias("source"),
        as_of.alias("created_at"),
    )


def load_rejects(listing: DataFrame) -> DataFrame:
    """Objects a load cannot take, with `reasons`: bad keys, and rows that break a table rule."""
    return _with_reasons(listing).where(F.size("reasons") > 0).select(*listing.columns, "reasons")


def _with_reasons(listing: DataFrame) -> DataFrame:
    """Key fields of listed objects, and the `reasons` why a load cannot take them (none: it can)."""
    few = F.when(~F.coalesce(is_valid_key("key"), F.lit(False)), F.array(F.lit("key: fewer than 4 parts")))
    return listing.select("*", *key_fields("key")).withColumn("reasons", F.coalesce(few, broken_rules("datasets")))


def record_rows(records: DataFrame, as_of: Column) -> DataFrame:
    """Catalogue rows of shards described by a caller: language `en` if not given."""
    given = set(records.columns)

    def column(name: str, type_: str, absent: object) -> Column:
        value = F.col(name) if name in given else F.lit(absent)
        return value.cast(type_).alias(name)

    return records.select(
        F.col("name"),
        column("language", "string", RECORD_LANGUAGE),
        F.col("data_type"),
        F.col("md5"),
        column("num_of_records", "int", None),
        column("decompressed_byte_size", "bigint", None),
        F.col("byte_size").cast("bigint"),
        column("source", "string", None),
        as_of.alias("created_at"),
    )


def add_to_catalog(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert-ignore on md5. Among new rows the smallest key wins, as in listing order."""
    return insert_ignore(catalog, rows, ["md5"], [F.col("key")])


def new_catalog(rows: DataFrame) -> DataFrame:
    """The catalogue after a first load."""
    return first_per_key(rows, ["md5"], [F.col("key")]).select(*CATALOG_COLUMNS)


def last_key(catalog: DataFrame) -> DataFrame:
    """Last key per (name, data_type): where a load resumes."""
    return catalog.groupBy("name", "data_type").agg(F.max(object_key()).alias("last_key"))


def last_key_overall(catalog: DataFrame) -> DataFrame:
    """Key of the newest row of any dataset, in one row."""
    newest = F.max_by(object_key(), F.struct("created_at", object_key()))
    return catalog.agg(F.coalesce(newest, F.lit("")).alias("last_key"))


def load_dataset(
    listing: DataFrame, catalog: DataFrame, loads: DataFrame, as_of: Column, resume: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Load all `loads` (name, data_type), from the last key on if `resume`.

    Gives the catalogue after it, and the listed objects that could not be taken, with `reasons`.
    """
    wanted = loads.select("name", "data_type")
    if resume:
        after = last_key(catalog).withColumnRenamed("last_key", "start_after")
        wanted = wanted.join(after, ["name", "data_type"], "left")
    # Stored: it is measured before it is used, and may rest on an aggregate of the whole catalogue.
    listed = list_loads(listing, store(wanted, "loads")).select(*listing.columns)
    rows, _ = check_constraints(catalog_rows(listed, as_of), "datasets")
    return add_to_catalog(catalog, rows), load_rejects(listed)


@dataclass(frozen=True)
class Load:
    """A load's catalogue, what it added to it and could not take, and its counts: listed, parsed, rejected, inserted."""

    catalog: DataFrame
    added: DataFrame
    rejects: DataFrame
    report: dict[str, int]


def reported_load(
    listing: DataFrame, catalog: DataFrame, loads: DataFrame, as_of: Column, resume: bool = False
) -> Load:
    """`load_dataset` with the counts of the load itself.

    The listing is read once: its part is stored with its key's fields and reasons, from which come both
    rows and rejects, and what is written is counted as it is written.
    """
    wanted = loads.select("name", "data_type")
    if resume:
        after = last_key(catalog).withColumnRenamed("last_key", "start_after")
        wanted = wanted.join(after, ["name", "data_type"], "left")
    listed = list_loads(listing, store(wanted, "loads")).select(*listing.columns)
    seen, new = Observation(), Observation()
    judged = _with_reasons(listed).observe(
        seen, F.count("*").alias("listed"), F.count_if(is_valid_key("key")).alias("parsed"),
        F.count_if(F.size("reasons") > 0).alias("rejected"),
    )
    judged = store(judged.select(*listing.columns, "reasons"), "judged")
    rows = catalog_rows(judged.where(F.size("reasons") == 0), as_of)
    added = rows_to_insert(catalog, rows, ["md5"], [F.col("key")]).select(*catalog.columns)
    added = store(added.observe(new, F.count("*").alias("inserted")), "added")
    rejects = judged.where(F.size("reasons") > 0)
    return Load(catalog.unionByName(added), added, rejects, {**seen.get, **new.get})


def dataset_stats(catalog: DataFrame, as_of: Column) -> DataFrame:
    """Shards per language, data type and dataset."""
    return catalog.groupBy(*STATS_KEYS).agg(
        F.count("*").alias("total_objects")
    ).withColumn("created_at", as_of)


def update_stats(stats: DataFrame, catalog: DataFrame, as_of: Column) -> DataFrame:
    """Renew the statistics of all present groups; vanished groups keep their row."""
    return upsert(stats, store(dataset_stats(catalog, as_of), "stats"), STATS_KEYS)


def ingest_report(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: objects listed, keys parsed, keys in error, shards a load would add."""
    parsed = F.col("parsed")
    checked = listing.select(is_valid_key("key").alias("parsed"), *key_fields("key")).select(
        "parsed", F.when(parsed, F.col("md5")).alias("md5"),
        (parsed & keeps_rules("datasets")).alias("ok"),
    )
    per_shard = checked.groupBy("md5").agg(
        F.count("*").alias("listed"), F.count_if("parsed").alias("processed"), F.max("ok").alias("ok")
    )
    known = catalog.select("md5", F.lit(True).alias("known"))
    return per_shard.join(known, "md5", "left").agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.col("listed") - F.col("processed")), F.lit(0)).alias("errors"),
        F.count_if(F.col("ok") & F.col("known").isNull()).alias("inserted"),
    )

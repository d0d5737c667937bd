"""Keyed tables in folders by hash of the key, so that a write reads and rewrites only the folders it touches.

Rows lie in `<path>/rows/<lot>/cluster=<n>`; a version is a small table of the folders that make it up
(`<path>/versions/<v>`, at most a row a cluster and delete). Folders are never changed, so readers of an
older version see it whole. A version counts once its marker is there, which is written last: a
writer that dies leaves folders that no version names. Only one writer may work on a table at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from shardlens.durable import store
from shardlens.operators.keyed import absent_rows, first_per_key, upsert
from shardlens.operators.lookup import lookup_join, without_keys

CLUSTER = "cluster"
# `gone` is NULL for a folder of rows, else the columns by which its keys are deleted from the cluster.
_VERSION = "cluster int, lot string, gone array<string>"
_ABOUT = "keys array<string>, clusters int, schema string"


class ClusteredTable:
    """One version of a clustered table: the newest, unless `version` is given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        about = spark.read.schema(_ABOUT).json(f"{path}/about").first()
        self.keys, self.clusters = about["keys"], about["clusters"]
        self.schema = StructType.fromJson(json.loads(about["schema"]))
        self.version = _newest(spark, path) if version is None else version
        # At most a row for each cluster and delete.
        self.folders = spark.read.schema(_VERSION).json(f"{path}/versions/{self.version}").collect()

    def read(self) -> DataFrame:
        return self._rows(range(self.clusters))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in `keys` (the key columns). Opens only their clusters."""
        wanted = store(keys.select(*self.keys).distinct(), "keys")
        return self._rows(self._touched(wanted)).join(wanted, self.keys, "left_semi").select(*self.schema.names)

    def upsert(self, new: DataFrame, order: list[Column | str]) -> ClusteredTable:
        """`new` rows replace those with their key; of several with one key the first by `order` counts."""
        return self._merge(new, order, upsert)

    def insert(self, new: DataFrame, order: list[Column | str]) -> ClusteredTable:
        """The first new row of every key that the table lacks; rows of the table always win."""
        return self._merge(new, order, lambda old, first, keys: old.unionByName(absent_rows(old, first, keys)))

    def delete(self, gone: DataFrame) -> ClusteredTable:
        """Rows that agree with `gone` in all its columns go.

        Only `gone` is written; a cluster's rows are rewritten without them by its next merge or by `fold`. Keys touch their
        clusters, other columns (as all jobs of a query) touch all. Nulls agree with nothing.
        """
        by = self.keys if set(gone.columns) == set(self.keys) else gone.columns
        wanted = store(gone.select(*by).where(~_incomplete(by)).distinct(), "gone")
        if by == self.keys:
            clusters = self._touched(wanted)
            lot = self._write(wanted)
        else:
            clusters, lot = [f["cluster"] for f in self.folders if f["gone"] is None], uuid.uuid4().hex
            wanted.write.parquet(f"{self.path}/rows/{lot}")
        present = {f["cluster"] for f in self.folders if f["gone"] is None}
        return self._commit([*self.folders, *[(c, lot, by) for c in clusters if c in present]])

    def fold(self) -> ClusteredTable:
        """Rewrite the clusters that hold deleted rows, and no others."""
        return self._replace({f["cluster"] for f in self.folders if f["gone"] is not None}, lambda old: old)

    def _merge(self, new: DataFrame, order: list[Column | str], merge) -> ClusteredTable:
        first = store(first_per_key(new.select(*self.schema.names), self.keys, order), "first")
        return self._replace(set(self._touched(first)), lambda old: merge(old, first, self.keys))

    def _replace(self, clusters: set[int], change) -> ClusteredTable:
        if not clusters:
            return self
        lot = self._write(change(self._rows(clusters)))
        kept = [f for f in self.folders if f["cluster"] not in clusters]
        return self._commit([*kept, *[(c, lot, None) for c in _written(self.spark, f"{self.path}/rows/{lot}")]])

    def _touched(self, rows: DataFrame) -> list[int]:
        found = rows.select(cluster_of(self.keys, self.clusters).alias(CLUSTER), _incomplete(self.keys).alias("bad"))
        seen = found.groupBy(CLUSTER).agg(F.max("bad").alias("bad")).collect()
        if any(r["bad"] for r in seen):
            raise ValueError(f"a key of {self.keys} is NULL")
        return sorted(r[CLUSTER] for r in seen)

    def _rows(self, clusters) -> DataFrame:
        """Rows of some clusters; those with the same deletes are read together."""
        wanted, groups = set(clusters), {}
        lots = {f["cluster"]: f["lot"] for f in self.folders if f["gone"] is None and f["cluster"] in wanted}
        for cluster, lot in lots.items():
            deletes = tuple(sorted((f["lot"], tuple(f["gone"])) for f in self.folders if f["cluster"] == cluster and f["gone"] is not None))
            groups.setdefault(deletes, []).append(f"{self.path}/rows/{lot}/{CLUSTER}={cluster}")
        parts = [self._without(self.spark.read.schema(self.schema).parquet(*paths), deletes) for deletes, paths in groups.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def _without(self, rows: DataFrame, deletes) -> DataFrame:
        for lot, by in deletes:
            schema = StructType([self.schema[c] for c in by])
            gone = self.spark.read.schema(schema).parquet(f"{self.path}/rows/{lot}").select(*by)
            # A value that is not a key may be that of a third of all rows.
            rows = without_keys(rows, gone) if list(by) == self.keys else lookup_join(rows, gone, list(by), self.keys, "left_anti")
        return rows.select(*self.schema.names)

    def _write(self, rows: DataFrame) -> str:
        lot = uuid.uuid4().hex
        placed = rows.withColumn(CLUSTER, cluster_of(self.keys, self.clusters))
        # Evens out the writing tasks; a cluster above their size gets several files.
        placed.hint("rebalance", CLUSTER).write.partitionBy(CLUSTER).parquet(f"{self.path}/rows/{lot}")
        return lot

    def _commit(self, folders: list) -> ClusteredTable:
        version = self.version + 1
        rows = self.spark.createDataFrame([tuple(f) for f in folders], _VERSION)
        # What a dead writer left of this version is not marked as done.
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/{version}")
        return ClusteredTable(self.spark, self.path, version)


def create_clustered(rows: DataFrame, path: str, keys: list[str], clusters: int, order: list[Column | str]) -> ClusteredTable:
    """A new table of the first row of each key. Choose `clusters` so that one holds some hundred megabytes.

    The columns may not include one named `cluster`. A NULL in a key is refused.
    """
    if CLUSTER in rows.columns:
        raise ValueError(f"{CLUSTER} names the folders")
    spark = rows.sparkSession
    about = spark.createDataFrame([(keys, clusters, rows.schema.json())], _ABOUT)
    about.coalesce(1).write.mode("errorifexists").json(f"{path}/about")
    spark.createDataFrame([], _VERSION).coalesce(1).write.json(f"{path}/versions/0")
    return ClusteredTable(spark, path, 0).upsert(rows, order)


def cluster_of(keys: list[str], clusters: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(clusters)).cast("int")


def _incomplete(keys: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])


def _newest(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [
        int(s.getPath().getName()) for s in files.listStatus(folder)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done)


def _written(spark: SparkSession, lot: str) -> list[int]:
    """The clusters of a lot. One that lost all its rows has no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(lot)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{CLUSTER}="))

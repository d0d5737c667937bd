"""Exact k-means over integer vectors with heap-ordered bounds.

For each vector the gap between its second nearest and its nearest centroid is
kept. While centroids move, the gap can shrink by no more than the way of its own
centroid and the longest way of another one. These ways are added up per cluster,
and a vector's key is its gap plus the sum at the time it was scanned: as long as the
key is above the sum of today, its cluster is certain. Each cluster of a block
keeps its keys in a heap, so a round pops the expired vectors from the top,
scans those against all centroids, and looks at no other.

Vectors lie in blocks of bounded size, in buckets by block number. The heaps of a
block are a row of a second table with the same buckets, so a round joins the two
without a shuffle and writes heaps and sums only. The driver holds k centroids.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.durable import durable_folder, store
from shardlens.llm.common import arrow_schema, columns_of, to_batch

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
# Integers are held within this, so that a squared distance over 64 of them fits into a long.
LARGEST = 1 << 27
BLOCK = 2048
BUCKET_VECTORS = 1 << 14
MAX_BUCKETS = 1 << 16
# Keys are lowered by this share, far more than floating point can be off.
SLACK = 1e-9

BLOCKS = "block bigint, keys array<bigint>, points binary"
HEAPS = (
    "block bigint, sizes array<int>, gaps binary, members binary, "
    "counts array<bigint>, sums array<bigint>, scanned bigint"
)
ASSIGNED = "key bigint, cluster int, distance bigint"
LONG_MAX = (1 << 63) - 1


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, point) of the rows whose embedding has `dimensions` components, none null or non-finite.

    A component x becomes floor(scale * x), in doubles, held within +-2^27. Other columns are not read.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.greatest(
        F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * v.cast("double")))
    ).cast("int"))
    kept = rows.where(x.isNotNull() & (F.size(x) == dimensions) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("key"), whole.alias("point"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The points of the k keys with the smallest sha256 of `seed:key`; a null key comes last, ties go by the point."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in rows], dtype=np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(points, centroids), exact in 64-bit integers."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = points - centroid
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number at ties), gap to the second nearest, distance to that."""
    far = squared_distances(points, centroids)
    nearest = far.argmin(axis=1)
    if len(centroids) == 1:
        endless = np.full(len(points), np.inf)
        return nearest, endless, np.zeros(len(points))
    first = far[np.arange(len(points)), nearest]
    far[np.arange(len(points)), nearest] = LONG_MAX
    second = np.sqrt(far.min(axis=1).astype(float))
    return nearest, second - np.sqrt(first.astype(float)), second


class BlockHeaps:
    """The heaps of one block: for each cluster (key, row), smallest key on top."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def empty(cls, k: int) -> BlockHeaps:
        return cls([[] for _ in range(k)])

    @classmethod
    def unpack(cls, sizes: list[int], gaps: bytes, members: bytes) -> BlockHeaps:
        keys, rows = np.frombuffer(gaps, "<f8").tolist(), np.frombuffer(members, "<i4").tolist()
        heaps, at = [], 0
        for size in sizes:
            heaps.append(list(zip(keys[at:at + size], rows[at:at + size])))
            at += size
        return cls(heaps)

    def pack(self) -> tuple[list[int], bytes, bytes]:
        keys = np.array([key for heap in self.heaps for key, _ in heap], "<f8")
        rows = np.array([row for heap in self.heaps for _, row in heap], "<i4")
        return [len(heap) for heap in self.heaps], keys.tobytes(), rows.tobytes()

    def pop_expired(self, sums: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows whose cluster is no longer certain, and the clusters they were in."""
        rows, was = [], []
        for cluster, heap in enumerate(self.heaps):
            limit = sums[cluster]
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                was.append(cluster)
        return rows, was

    def push(self, rows: list[int], clusters: np.ndarray, gaps: np.ndarray, second: np.ndarray, sums: np.ndarray) -> None:
        sum_now = sums[clusters]
        keys = gaps + sum_now - SLACK * (second + sum_now + 1)
        for row, cluster, key in zip(rows, clusters.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[cluster], (key, row))

    def members(self) -> np.ndarray:
        """The cluster of each row."""
        out = np.zeros(sum(map(len, self.heaps)), np.int64)
        for cluster, heap in enumerate(self.heaps):
            out[[row for _, row in heap]] = cluster
        return out


@dataclass
class Clusters:
    """Centroids, and (key, cluster, distance) of every vector; `scanned` counts the exact scans of each round."""

    centroids: list[list[int]]
    assigned: DataFrame
    scanned: list[int] = field(default_factory=list)


class BucketedTables:
    """Tables in the shared folder with the same buckets by block; their names are dropped at the end."""

    def __init__(self, spark: SparkSession, n_vectors: int):
        self.spark = spark
        self.buckets = max(1, min(MAX_BUCKETS, -(-n_vectors // BUCKET_VECTORS)))
        self.names: list[str] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"llm_{label}_{uuid.uuid4().hex}"
        path = f"{durable_folder(self.spark)}/tables/{name}"
        df.write.bucketBy(self.buckets, "block").option("path", path).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_blocks(vectors: DataFrame) -> DataFrame:
    """Rows of up to BLOCK vectors: block number, keys and points as 32-bit integers."""
    fields = arrow_schema(vectors.sparkSession, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                points = part.column("point").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield to_batch([(number, part.column("key").to_pylist(), points.tobytes())], fields)
                number += 1

    return vectors.mapInArrow(run, BLOCKS)


def _points(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(n, -1).astype(np.int64)


def _sums(points: np.ndarray, clusters: np.ndarray, k: int, sign: int, counts: np.ndarray, sums: np.ndarray) -> None:
    np.add.at(counts, clusters, sign)
    np.add.at(sums, clusters, sign * points)


def assigned_first(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Heaps of every block after a full scan, with counts and sums of its clusters."""
    fields = arrow_schema(blocks.sparkSession, HEAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for batch in batches:
            for block, keys, data in zip(*columns_of(batch, "block", "keys", "points")):
                points = _points(data, len(keys))
                clusters, gaps, second = scan(points, centroids)
                heaps = BlockHeaps.empty(k)
                heaps.push(list(range(len(points))), clusters, gaps, second, np.zeros(k))
                counts, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
                _sums(points, clusters, k, 1, counts, sums)
                yield to_batch([(block, *heaps.pack(), counts.tolist(), sums.ravel().tolist(), len(points))], fields)

    return blocks.mapInArrow(run, HEAPS)


def reassigned(blocks: DataFrame, heaps: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Heaps after the expired vectors were scanned; counts and sums are those that joined less those that left."""
    fields = arrow_schema(blocks.sparkSession, HEAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for batch in batches:
            read = columns_of(batch, "block", "n", "points", "sizes", "gaps", "members")
            for block, n, data, sizes, gaps, members in zip(*read):
                own = BlockHeaps.unpack(sizes, gaps, members)
                rows, was = own.pop_expired(drift)
                counts, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
                if rows:
                    points = np.frombuffer(data, "<i4").reshape(n, -1)[rows].astype(np.int64)
                    clusters, gap, second = scan(points, centroids)
                    own.push(rows, clusters, gap, second, drift)
                    moved = clusters != np.array(was)
                    _sums(points[moved], clusters[moved], k, 1, counts, sums)
                    _sums(points[moved], np.array(was)[moved], k, -1, counts, sums)
                yield to_batch([(block, *own.pack(), counts.tolist(), sums.ravel().tolist(), len(rows))], fields)

    both = blocks.select("block", F.size("keys").alias("n"), "points").join(
        heaps.select("block", "sizes", "gaps", "members"), "block"
    )
    return both.mapInArrow(run, HEAPS)


def with_distances(blocks: DataFrame, heaps: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector, exactly."""
    fields = arrow_schema(blocks.sparkSession, ASSIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data, sizes, gaps, members in zip(*columns_of(batch, "keys", "points", "sizes", "gaps", "members")):
                clusters = BlockHeaps.unpack(sizes, gaps, members).members()
                apart = _points(data, len(keys)) - centroids[clusters]
                far = np.einsum("ij,ij->i", apart, apart)
                yield pa.record_batch([
                    pa.array(keys, pa.int64()), pa.array(clusters, pa.int32()), pa.array(far, pa.int64())
                ], schema=fields)

    return blocks.join(heaps.select("block", "sizes", "gaps", "members"), "block").mapInArrow(run, ASSIGNED)


def _totals(heaps: DataFrame, column: str, length: int) -> list[int]:
    """The sums over all blocks of an array column of `length` numbers."""
    at = heaps.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = [0] * length
    for row in at.collect():
        out[row["at"]] = int(row["n"])
    return out


def _way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    return np.sqrt(((a - b) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> Clusters:
    """Lloyd's rounds over (key, point) from given centroids, then one more assignment.

    A non-empty cluster's centroid becomes floor(sum / count) of each component,
    exactly; an empty one stays. Rounds that could change nothing any more are left out.
    """
    spark = vectors.sparkSession
    tables = BucketedTables(spark, vectors.count())
    try:
        blocks = tables.write(in_blocks(vectors).repartition(tables.buckets, "block"), "blocks")
        k, dimensions = centroids.shape
        heaps = tables.write(assigned_first(blocks, centroids), "heaps")
        counts, sums, drift, scanned = [0] * k, [0] * (k * dimensions), np.zeros(k), []
        for _ in range(rounds):
            counts = [a + b for a, b in zip(counts, _totals(heaps, "counts", k))]
            sums = [a + b for a, b in zip(sums, _totals(heaps, "sums", k * dimensions))]
            scanned.append(heaps.agg(F.sum("scanned")).first()[0] or 0)
            moved = np.array([
                [sums[c * dimensions + d] // counts[c] if counts[c] else int(centroids[c, d]) for d in range(dimensions)]
                for c in range(k)
            ], dtype=np.int64)
            way = _way(moved, centroids)
            if not way.any():
                break
            others = np.array([max((way[j] for j in range(k) if j != c), default=0.0) for c in range(k)])
            drift, centroids = drift + way + others, moved
            heaps = tables.write(reassigned(blocks, heaps, centroids, drift), "heaps")
        assigned = store(with_distances(blocks, heaps, centroids), "clusters")
    finally:
        tables.forget()
    return Clusters([list(map(int, c)) for c in centroids], assigned, scanned)


def clustered(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector of `rows`.

    Rows with a null, short, long or non-finite embedding have no row in the
    result; an empty table gives an empty one. A null vec_id takes part like any
    other and is the last choice for a first centroid. Repeated rows count as often as
    they come. With fewer than k vectors there are as many clusters. Inertia beyond a
    long is the largest long.
    """
    vectors = whole_vectors(rows, dimensions)
    start = first_centroids(vectors, k, seed)
    if not len(start):
        empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    found = cluster(vectors, start, rounds)
    by_cluster = {
        r["cluster"]: int(r["total"])
        for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    each = F.array(*[F.lit(min(by_cluster.get(c, 0), LONG_MAX)).cast("bigint") for c in range(len(start))])
    names = F.array(*[F.lit(",".join(map(str, c))) for c in found.centroids])
    return found.assigned.select(
        F.col("key").alias("vec_id"), "cluster", "distance",
        each[F.col("cluster")].alias("cluster_inertia"),
        F.lit(min(sum(by_cluster.values()), LONG_MAX)).cast("bigint").alias("inertia"),
        F.sha2(names[F.col("cluster")], 256).alias("centroid_sha256"),
    )

"""Near duplicates by circulant MinHash, confirmed on full shingle sets.

One permutation places a shingle on a ring; the coordinates of a signature are
the least values of a second permutation read from that place, shifted one step
for each coordinate. So two permutations give a signature of any length.

Documents with equal sets are one class and stand for one another. Classes that
agree on a band share a bucket; each is compared with a hub of the bucket, first
the smallest, then the largest id. Links found so far make most buckets one
component. In a bucket with several, sets are seen by what they lose and add against
one common set. Two sets that are similar enough must share added shingles, of which
only the rarest are listed, unless both lose so little that sizes alone decide; these
few pairs are found by sizes. So no bucket's pairs are taken one by one, and
components are those of all links that share a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shardlens.durable import store
from shardlens.llm.common import arrow_schema, back_to_doc_id, row_id, rows_of, small_batches, texts, to_batch

SHINGLE = 5
PERCENT = 80
BANDS = 32
ROWS = 4
# A pair at 80 % is missed by all bands with a chance of (1 - 0.8^4)^32 = 5e-8.
RING_BITS = 20
CHUNK = 1 << 12
# Pairs and ids of so many bytes at most are sent to all tasks.
BROADCAST_BYTES = 4 << 20
# Shingles of remembered sets while links are confirmed.
HELD_SHINGLES = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

SIGNED = "_id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `size` words; fewer words are one shingle, no words none."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(words) - size + 1)
    total = np.zeros(runs, np.uint64)
    for i in range(min(size, len(words))):
        total = _mixed(total + h[i:i + runs] + np.uint64(i + 1))
    return np.unique(total)


class CirculantSigner:
    """Signatures of `bands` * `rows` coordinates from two seeded permutations of a ring."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1, ring_bits: int = RING_BITS):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mask = np.uint64((1 << ring_bits) - 1)
        self.places = random.permutation(1 << ring_bits).astype(np.uint32)
        ring = random.permutation(1 << ring_bits).astype(np.uint32)
        length = bands * rows
        # Row p is the second permutation shifted by p, as a view of the ring unrolled.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:length - 1]]), length)
        self.number = np.arange(bands, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = np.unique(self.places[(hashes & self.mask).astype(np.int64)])
        least = None
        for i in range(0, len(places), CHUNK):
            part = self.shifted[places[i:i + CHUNK]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        by_band = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.rows)
        key = self.number
        for i in range(self.rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, i])
        return key.view(np.int64)


def signed(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_id, n_shingles, digest of the set, band keys) of each row; no bands for an empty set."""
    fields = arrow_schema(docs.sparkSession, SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = CirculantSigner(bands, rows)
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch, "_id", "text"):
                h = shingle_hashes(words_of(text), shingle)
                keys = signer.band_keys(h).tolist() if len(h) else []
                out.append((doc_id, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), keys))
            yield to_batch(out, fields)

    return texts(docs).mapInArrow(run, SIGNED)


def _of_ids(rows: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """`rows` whose _id is one of `ids`; the rows stay where they are if `ids` are few."""
    return rows.join(F.broadcast(ids) if few else ids, "_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those (a, b) whose full shingle sets of words reach `percent` of their union.

    Texts meet the pairs by joins on ids; Spark splits those of a hub that has
    many partners. Few pairs, by their number, are sent to the texts instead. A set is kept while the same document comes again.
    """
    fields = arrow_schema(pairs.sparkSession, "a bigint, b bigint")
    pairs = pairs.select("a", "b")
    few = 16 * pairs.count() <= BROADCAST_BYTES
    left = texts(docs).select(F.col("_id").alias("a"), F.col("text").alias("_left"))
    ids = pairs.select(F.col("b").alias("_id"))
    right = _of_ids(texts(docs), ids if few else ids.distinct(), few)
    right = right.select(F.col("_id").alias("b"), F.col("text").alias("_right"))
    met = left.join(F.broadcast(pairs) if few else pairs, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set] = {}
        held = 0

        def of(text: str) -> set:
            nonlocal held
            if text not in sets:
                if held > HELD_SHINGLES:
                    sets.clear()
                    held = 0
                sets[text] = shingles(words_of(text), shingle)
                held += len(sets[text])
            return sets[text]

        for batch in batches:
            out = []
            for a, b, x, y in rows_of(batch, "a", "b", "_left", "_right"):
                x, y = of(x), of(y)
                if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(x & y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, b))
            yield to_batch(out, fields)

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _both_ways(edges: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """(a, b) of the two named columns of each row, once for each of `ways`; nothing is read twice."""
    return edges.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ways])).alias("_e")).select("_e.*")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a of distinct (a, b), a > b, has one b only, which is nobody's a."""
    nodes = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("_id"), F.lit(1).alias("_up"), F.lit(0).alias("_down")),
        F.struct(F.col("b").alias("_id"), F.lit(0).alias("_up"), F.lit(1).alias("_down")),
    )).alias("_e")).select("_e.*").groupBy("_id").agg(F.sum("_up").alias("_up"), F.max("_down").alias("_down"))
    return nodes.agg(F.sum(((F.col("_up") > 1) | ((F.col("_up") > 0) & (F.col("_down") > 0))).cast("bigint"))).first()[0] in (0, None)


def components(edges: DataFrame) -> DataFrame:
    """(_id, component): the smallest id reachable, for every id of `edges` (a, b).

    Rounds of large and small stars: each node hands its smallest neighbour to
    its larger, then to its smaller ones, until every node points to the least.
    Only minima per node are gathered. Both halves of a round are stored tables,
    so that no plan holds what it reads more than twice: the driver keeps all plans.
    """
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        least = _both_ways(edges, ("a", "b"), ("b", "a")).groupBy("a").agg(F.min("b").alias("_least"))
        least = least.select(F.col("a").alias("b"), F.least("_least", "a").alias("_least"))
        large = store(edges.join(least, "b").select("a", F.col("_least").alias("b")), "large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("_least")), "a")
        edges = store(_both_ways(small, ("a", "_least"), ("b", "_least")).where("a <> b").distinct(), "edges")
    pointed = edges.select(F.col("a").alias("_id"), F.col("b").alias("component"))
    return pointed.unionByName(edges.select(F.col("b").alias("_id"), F.col("b").alias("component")).distinct())


def _compatible(percent: int) -> Column:
    return (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))


def _pairs_with_hub(buckets: DataFrame, percent: int, pick: Callable) -> DataFrame:
    """Distinct (a, b) of each row and its bucket's hub, if they lie in different components and may be similar."""
    hubs = buckets.groupBy("key").agg(
        pick(F.struct("_id", "n", "component")).alias("_hub"), F.min("component").alias("_low"), F.max("component").alias("_high")
    ).where("_low <> _high").select("key", F.col("_hub._id").alias("_b"), F.col("_hub.n").alias("_n"), F.col("_hub.component").alias("_c"))
    return (
        buckets.join(hubs, "key").where(F.col("component") != F.col("_c")).where(_compatible(percent))
        .select(F.greatest("_id", "_b").alias("a"), F.least("_id", "_b").alias("b")).distinct()
    )


def _pairs_with_smallest(buckets: DataFrame, percent: int) -> DataFrame:
    return _pairs_with_hub(buckets, percent, F.min)


def _pairs_with_largest(buckets: DataFrame, percent: int) -> DataFrame:
    return _pairs_with_hub(buckets, percent, F.max)


def _shingle_lists(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(_id, variant, hashes) of every text of `ids`; the texts of one id differ by `variant`."""
    fields = arrow_schema(docs.sparkSession, "_id bigint, variant bigint, hashes array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in rows_of(batch, "_id", "text"):
                hashes = shingle_hashes(words_of(text), shingle)
                variant = xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
                yield to_batch([(doc_id, variant, hashes.view(np.int64).tolist())], fields)

    here = texts(docs).join(ids, "_id", "left_semi")
    listed = here.mapInArrow(run, "_id bigint, variant bigint, hashes array<bigint>")
    return listed.dropDuplicates(["_id", "variant"])


def _differences(docs: DataFrame, buckets: DataFrame, shingle: int) -> DataFrame:
    """What each set of an open bucket loses and adds against the set of the bucket's smallest component.

    (hub, variant, n_hub, _id, component, n, lost, new): one row for each hub, not for each bucket.
    """
    hubs = buckets.groupBy("key").agg(F.min("component").alias("hub"))
    members = store(buckets.join(hubs, "key").select("hub", "_id", "component").distinct(), "members")
    ids = members.select("_id").unionByName(members.select(F.col("hub").alias("_id"))).distinct()
    lists = store(_shingle_lists(docs, ids, shingle), "shingles")
    base = lists.select(F.col("_id").alias("hub"), "variant", F.col("hashes").alias("_base"))
    met = members.join(lists.select("_id", "hashes"), "_id").join(base, "hub")
    n_hub = F.size("_base")
    return met.select(
        "hub", "variant", n_hub.alias("n_hub"), "_id", "component", F.size("hashes").alias("n"),
        (n_hub - F.size(F.array_intersect("hashes", "_base"))).alias("lost"),
        F.array_except("hashes", "_base").alias("new"),
    ).where((F.col("lost") > 0) | (F.size("new") > 0))


_OTHER = {"_id": "_b", "component": "_c", "n": "_n", "lost": "_lost", "rest": "_rest"}


def _must_share(percent: int, lost: Column, sizes: Column) -> Column:
    """100 + percent times the number of added shingles that two sets must share to be similar.

    They share the hub's shingles that neither lost, n_hub - lost at most, and added ones;
    percent / (100 + percent) of both sizes is needed.
    """
    return (100 + percent) * (lost - F.col("n_hub")) + percent * sizes


def _pairs_with_new_shingles(differences: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) in different components that share one of their rarest added shingles and may be similar.

    A set that must share at least t of its added shingles with any partner shares
    one of all but its t - 1 commonest ones. Of the first that two sets share, no
    more than `rest` are left in either, which must be enough for their sizes.
    """
    partner = F.ceil(F.col("n") * percent / 100)
    least = F.ceil(_must_share(percent, F.col("lost"), F.col("n") + partner) / (100 + percent))
    rows = differences.withColumn("_least", F.greatest(F.lit(1), least).cast("int"))
    added = store(rows.withColumn("hash", F.explode("new")).drop("new"), "added")
    group = ["hub", "variant"]
    common = added.groupBy(*group, "hash").agg(F.count("*").alias("_docs")).where("_docs > 1")
    row = [*group, "n_hub", "_id", "component", "n", "lost", "_least"]
    listed = added.join(common, [*group, "hash"]).groupBy(*row).agg(
        F.sort_array(F.collect_list(F.struct("_docs", "hash"))).alias("_shared")
    )
    kept = F.size("_shared") - F.col("_least") + 1
    posted = store(
        listed.where(kept > 0).select(
            *row[:-1], F.size("_shared").alias("_size"), F.posexplode(F.slice("_shared.hash", F.lit(1), kept)).alias("_at", "hash")
        ).withColumn("rest", F.col("_size") - F.col("_at")).drop("_size", "_at"),
        "posted",
    )
    other = posted.select(*group, "hash", *[F.col(c).alias(o) for c, o in _OTHER.items()])
    enough = _must_share(percent, F.greatest("lost", "_lost"), F.col("n") + F.col("_n")) <= (100 + percent) * F.least("rest", "_rest")
    return (
        posted.join(other, [*group, "hash"]).where("component < _c").where(_compatible(percent)).where(enough)
        .select(F.greatest("_id", "_b").alias("a"), F.least("_id", "_b").alias("b")).distinct()
    )


def _pairs_by_sizes(differences: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) in different components that may be similar without a common added shingle.

    That depends on n and lost alone, so kinds of equal sizes meet first, then the sets of those kinds that fit.
    """
    sets = store(differences.drop("new"), "sizes")
    kind = ["hub", "variant", "n_hub", "n", "lost"]
    kinds = sets.groupBy(*kind).agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    partners = kinds.select("hub", "variant", F.col("n").alias("_n"), F.col("lost").alias("_lost"),
                            F.col("_low").alias("_low2"), F.col("_high").alias("_high2"))
    one = (F.col("_low") == F.col("_high")) & (F.col("_low2") == F.col("_high2")) & (F.col("_low") == F.col("_low2"))
    fit = _must_share(percent, F.greatest("lost", "_lost"), F.col("n") + F.col("_n")) <= 0
    met = store(
        kinds.join(partners, ["hub", "variant"]).where(~one).where(_compatible(percent)).where(fit)
        .select("hub", "variant", "n", "lost", "_n", "_lost"),
        "kinds",
    )
    other = sets.select("hub", "variant", *[F.col(c).alias(o) for c, o in _OTHER.items() if c != "rest"])
    return (
        sets.join(met, ["hub", "variant", "n", "lost"]).join(other, ["hub", "variant", "_n", "_lost"]).where("component < _c")
        .select(F.greatest("_id", "_b").alias("a"), F.least("_id", "_b").alias("b")).distinct()
    )


def _star(labels: DataFrame) -> DataFrame:
    """Labels as links of every id with its component's smallest."""
    return labels.where("_id <> component").select(F.col("_id").alias("a"), F.col("component").alias("b"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs`.

    Rows that share a doc_id are one document: links of each hold for all. An
    empty set (null, empty or blank text) is linked with nothing. A null doc_id
    is one document after all others; as a component's smallest it stays null.
    Texts are taken whole, other columns are not read, and an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        return _members(*_linked(docs, shingle, percent, bands, rows))


def _linked(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, ...]:
    """Signatures, classes, components of the linked classes, and ids with several texts."""
    signatures = store(signed(docs, shingle, bands, rows), "signatures")
    classes = store(
        signatures.where("n_shingles > 0").groupBy("digest").agg(F.min("_id").alias("_class")), "classes"
    )
    represented = signatures.join(classes.select(F.col("_class").alias("_id")).distinct(), "_id", "left_semi")
    every = represented.where("n_shingles > 0").select(
        "_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")
    )
    shared = every.groupBy("key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low <> _high")
    buckets = store(
        every.join(shared.select("key"), "key", "left_semi").withColumn("component", F.col("_id")), "buckets"
    )
    # Rounds move the texts of shared buckets only.
    held = store(buckets.select("_id").distinct(), "ids")
    few = 16 * held.count() <= BROADCAST_BYTES
    texts_held = store(_of_ids(texts(docs), held, few).withColumnRenamed("_id", "doc_id"), "texts")
    several = signatures.groupBy("_id").agg(
        F.min("digest").alias("_low"), F.max("digest").alias("_high")
    ).where("_low <> _high").select("_id")
    labels = docs.sparkSession.createDataFrame([], "_id bigint, component bigint")
    tested = None
    for pairs_of in (_pairs_with_smallest, _pairs_with_largest, _pairs_with_new_shingles, _pairs_by_sizes):
        if pairs_of in (_pairs_with_smallest, _pairs_with_largest):
            pairs = pairs_of(buckets, percent)
        else:
            if pairs_of is _pairs_with_new_shingles:
                differences = store(_differences(texts_held, buckets, shingle), "differences")
            pairs = pairs_of(differences, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = store(confirmed(pairs, texts_held, shingle, percent), "links")
        if not found.isEmpty():
            labels = store(components(found.unionByName(_star(labels))), "labels")
        if pairs_of in (_pairs_with_smallest, _pairs_with_largest):
            buckets = store(_open_buckets(buckets, labels), "buckets")
            if buckets.isEmpty():
                break
    return signatures, classes, labels, several


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their components, of the buckets that still have several."""
    labelled = buckets.drop("component").join(labels, "_id", "left").withColumn(
        "component", F.coalesce("component", "_id")
    )
    several = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return labelled.join(several.where("_low <> _high").select("key"), "key", "left_semi")


def _members(signatures: DataFrame, classes: DataFrame, labels: DataFrame, same: DataFrame) -> DataFrame:
    """Every row with its component; rows of one class and rows of one doc_id belong together."""
    # Only rows of `same`, which share a doc_id, can join classes; others take their class's label.
    if not same.isEmpty():
        joined = signatures.where("n_shingles > 0").join(same, "_id", "left_semi").join(classes, "digest")
        more = joined.select(F.col("_id").alias("a"), F.col("_class").alias("b"))
        labels = store(components(more.unionByName(_star(labels))), "labels")
    row = signatures.join(classes, "digest", "left").select(
        "_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_class")).otherwise(F.col("_id")).alias("_class")
    )
    named = row.join(labels.withColumnRenamed("_id", "_class"), "_class", "left").select(
        "_id", "n_shingles", F.coalesce("component", "_class").alias("_component")
    )
    return named.select(
        back_to_doc_id().alias("doc_id"), "n_shingles",
        back_to_doc_id("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` without the rows of documents that stand in another one's group; all columns stay."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(row_id().alias("_llm_id")).distinct()
    return docs.join(gone, row_id() == F.col("_llm_id"), "left_anti")

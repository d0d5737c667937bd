"""Document fingerprints of closed syncmers, by DataFrame functions alone.

A text is a sequence of words (long words are cut into pieces). Of all runs of
`k` words those are chosen whose least inner run of `s` words, by hash, is the
first or the last. The choice depends on the run alone, so a passage keeps its
anchors wherever it stands. Any `k - s` runs in a row hold an anchor at least;
a text too short to have one has its whole word sequence as the only anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardlens.llm.common import BLANK, row_id, shuffle_width

K = 8
S = 2
PIECE_CHARS = 32
# Ranges of documents for each shuffle partition, so that partitions are even.
RANGES_PER_PARTITION = 6
# Bounds of ranges are read by the driver; they stay a short list at any size.
MAX_RANGES = 1 << 14
MASK = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in its order: array of (position in words, 32-bit hash).

    Null and blank texts have none.
    """
    words = F.transform(
        F.regexp_extract_all(text, F.lit(f"[^{BLANK}]{{1,{PIECE_CHARS}}}"), F.lit(0)),
        lambda w: F.xxhash64(w),
    )
    span = k - s

    def whole(h: Column) -> Column:
        return F.when(F.size(h) > 0, F.array(F.struct(F.lit(0).alias("pos"), _short(h).alias("hash")))).otherwise(
            F.array().cast("array<struct<pos:int,hash:bigint>>")
        )

    def _short(run: Column) -> Column:
        return F.xxhash64(run).bitwiseAND(F.lit(MASK))

    def chosen(h: Column, inner: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(h) - F.lit(k - 1))
        closed = F.filter(
            places,
            lambda i: F.array_min(F.slice(inner, i, span + 1)) == F.least(F.get(inner, i - 1), F.get(inner, i + F.lit(span - 1))),
        )
        return F.transform(
            closed, lambda i: F.struct((i - 1).alias("pos"), _short(F.slice(h, i, k)).alias("hash"))
        )

    def pick(h: Column) -> Column:
        def runs() -> Column:
            step = F.transform(
                F.sequence(F.lit(1), F.size(h) - F.lit(s - 1)), lambda i: F.xxhash64(F.slice(h, i, s))
            )
            return let(step, lambda inner: chosen(h, inner))

        found = F.when(F.size(h) >= k, runs())
        return let(found, lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(whole(h)))

    return F.coalesce(let(words, pick), F.array().cast("array<struct<pos:int,hash:bigint>>"))


def fingerprint(found: Column) -> Column:
    """The anchors' hashes in hexadecimal, in the order of the text."""
    return F.array_join(F.transform(found, lambda a: F.lower(F.hex(a["hash"]))), " ")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are equal."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def document_anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, pos, hash): one row per anchor of each row of `docs`, to match positions by equal hashes."""
    return docs.select("doc_id", F.inline(anchors(F.col("text"), k, s)))


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Ids that cut the documents into about equal ranges; each is an id of a row, the last the largest."""
    shares = [i / ranges for i in range(1, ranges + 1)]
    found = docs.agg(
        F.percentile_approx("_id", shares, F.lit(max(1000, 4 * ranges))).alias("cuts"), F.max("_id").alias("top")
    ).first()
    return sorted({*(found["cuts"] or []), *([] if found["top"] is None else [found["top"]])})


def with_next(docs: DataFrame, columns: list[str], bounds: list[int]) -> DataFrame:
    """Rows with `_bucket`, in which a window over `_bucket` in `descending` order sees every row's follower.

    Documents follow one another by descending doc_id, ties by text; the first
    follows the last. Each range gets the top document of the range below as a
    guest (`_guest`), the lowest range that of the highest. A null doc_id comes
    last of all, that is as the lowest.
    """
    cuts = F.array(*[F.lit(b) for b in bounds])
    # Binary search in a constant array would read nicer; a sum over ranges is a scan of it.
    place = F.size(F.filter(cuts, lambda b: b < F.col("_id")))
    homes = docs.withColumn("_home", place)
    at_top = F.get(cuts, F.col("_home")) == F.col("_id")
    guests = F.when(
        at_top,
        F.array(
            F.struct(F.col("_home").alias("_bucket"), F.lit(False).alias("_guest")),
            F.struct(((F.col("_home") + 1) % len(bounds)).alias("_bucket"), F.lit(True).alias("_guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("_home").alias("_bucket"), F.lit(False).alias("_guest"))))
    return homes.select(*columns, F.inline(guests))


def fingerprints_with_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. In the edited text, the last third is replaced by as
    many code points of the next document's start. Texts are shuffled once, by
    ranges of doc_id. Null text counts as empty; one document alone is its own next.
    """
    lowest = -(1 << 63)
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )
    ranges = min(MAX_RANGES, RANGES_PER_PARTITION * shuffle_width(docs.sparkSession))
    bounds = range_bounds(narrow, ranges)
    if not bounds:
        bounds = [0]
    placed = with_next(narrow, ["doc_id", "_id", "_text"], bounds)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("_id").desc(), "_text")
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    following = F.lead("_text").over(order)
    edited = placed.withColumn("_next", following).select(
        "doc_id", "_id", "_bucket", "_guest", "_text", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring("_text", F.lit(1), n - cut), F.coalesce(F.substring("_next", F.lit(1), cut), F.lit(""))).alias("_edited"),
    )
    marked = edited.select(
        "doc_id", "_id", "_bucket", "_guest", "_text", "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        anchors(F.col("_text"), k, s).alias("_anchors"),
        anchors(F.col("_edited"), k, s).alias("_edited_anchors"),
    )
    hashes = marked.select(
        "*", F.col("_anchors.hash").alias("_own"), F.col("_edited_anchors.hash").alias("_other")
    )
    met = hashes.withColumn("_following", F.lead("_own").over(order)).where(~F.col("_guest"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("_anchors")).alias("fingerprint"),
        fingerprint(F.col("_edited_anchors")).alias("edited_fingerprint"),
        likeness(F.array_distinct("_own"), F.array_distinct("_other")).alias("near_edited"),
        likeness(F.array_distinct("_own"), F.array_distinct("_following")).alias("near_next"),
    )

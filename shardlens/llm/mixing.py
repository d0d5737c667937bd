"""Mixing sources to target weights by Sainte-Lague apportionment.

Tokens are words. Sources get words of the mix by the highest quotients of their
targets, and hand them down to regions and shards of their documents by the same
rule. Within a shard, documents are laid out in seeded order and cut into equal
blocks, of a length that depends on this shard alone. Blocks are picked evenly
from a seeded phase, and the last of them is cut, so that their words are exactly the shard's
quota; a quota above the shard's own words repeats all of them. All steps are DataFrame
operations; groups in windows are bounded by `SHARD_DOCS` and `REGION_SHARDS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardlens.durable import store
from shardlens.llm.common import BLANK, row_id, with_text
from shardlens.operators.numbering import number_rows

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
SHARD_DOCS = 64
REGION_SHARDS = 1024
# Blocks a shard has at least, if it has as many words; more spread its quota finer.
BLOCKS_PER_SHARD = 256


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT
) -> DataFrame:
    """(source, source_size, n_docs, target) of a table with source and size.

    Sources in code point order, null last, weigh `weights`, repeating. Targets
    are in proportion to weights but stop at MAX_REPEATS times a source's size;
    what is cut goes to the others by weight, until none is above. A loop that
    sets more sources to their limit each time, on sums only.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    sources = sources.withColumn("_null", F.col("source").isNull())
    place = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    sources = store(
        number_rows(sources, [], ["_null", "source"], "_place").select(
            "source", "source_size", "n_docs", place.alias("_weight")
        ),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, limited = total * share_percent / 100, 0.0, -1
    limit = F.col("source_size") * MAX_REPEATS
    while True:
        above = limit <= F.lit(level) * F.col("_weight")
        full = sources.agg(
            F.sum(F.when(above, limit).otherwise(0)).alias("given"),
            F.sum(F.when(above, 0).otherwise(F.col("_weight"))).alias("weight"),
            F.sum(above.cast("bigint")).alias("n"),
        ).first()
        if full.n is None or full.n == limited or not full.weight:
            break
        limited, level = full.n, max(level, (wanted - full.given) / full.weight)
    return sources.select(
        "source", "source_size", "n_docs",
        F.least(limit.cast("double"), F.lit(float(level)) * F.col("_weight")).alias("target"),
    )


def apportion(parties: DataFrame, parent: list[str], key: str, seats: str, share: str, name: str) -> DataFrame:
    """Add `name`: the seats of each party by the highest quotients share / (2 n + 1).

    `parties` has, for every parent, its number of `seats` and the `share` of each
    party. Seats first are rounded shares; each parent then gives or takes the few
    that are missing or too many, in order of quotients, ties by `key`. A party can
    move by its share of those few and one more, so candidates are few as well.
    First seats are a stored table: they are read three times.
    """
    whole = Window.partitionBy(*parent)
    started = store(
        parties.withColumn("_total", F.sum(share).over(whole))
        .withColumn("_parties", F.count("*").over(whole))
        .withColumn("_part", F.when(F.col("_total") > 0, F.col(share) / F.col("_total")).otherwise(0.0))
        .withColumn("_first", F.floor(F.col("_part") * F.col(seats) + F.lit(0.5)).cast("bigint"))
        .withColumn("_missing", F.when(F.col("_total") > 0, F.col(seats)).otherwise(0) - F.sum("_first").over(whole))
        .withColumn(
            "_reach",
            F.ceil(F.col("_part") * (F.abs("_missing") + F.col("_parties"))).cast("bigint") + 1,
        ),
        "seats",
    )
    settled = started.where("_missing = 0")
    open_ = started.where("_missing <> 0")
    lowest = F.greatest(F.lit(0), F.col("_first") - F.col("_reach"))
    steps = F.when(
        F.col("_missing") > 0, F.sequence(F.col("_first"), F.col("_first") + F.col("_reach"))
    ).when(F.col("_first") > lowest, F.sequence(lowest, F.col("_first") - 1))
    quotient = F.col(share) / (F.col("_seat") * 2 + 1)
    rank = F.row_number().over(
        Window.partitionBy(*parent).orderBy(
            F.when(F.col("_missing") > 0, -quotient).otherwise(quotient), F.col(key).asc_nulls_last(), "_seat"
        )
    )
    moved = (
        open_.withColumn("_seat", F.explode(steps))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.abs("_missing"))
        .groupBy(*parent, key)
        .agg(F.count("*").alias("_moved"))
    )
    corrected = _with_parent(open_, moved, [*parent, key], "left").select(
        *parties.columns,
        (F.col("_first") + F.signum("_missing").cast("bigint") * F.coalesce("_moved", F.lit(0))).alias(name),
    )
    return settled.select(*parties.columns, F.col("_first").alias(name)).unionByName(corrected)


def picked_before(words: Column, block: Column, blocks: Column, quota: Column, phase: Column) -> Column:
    """How many of a shard's first `words` words stand in picked blocks.

    Of `blocks` blocks, `quota` are picked evenly: those at which
    floor((b * quota + phase) / blocks) rises.
    """
    def risen(b: Column) -> Column:
        return F.floor((b * quota + phase) / blocks)

    done = F.floor(words / block)
    return risen(done) * block + (words - done * block) * (risen(done + 1) - risen(done))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, seed: int = 17
) -> DataFrame:
    """How many words of each row of `docs` the mix takes, repeats counted.

    Gives doc_id, size, source_size, target (its source's) and taken. A null
    text has no words; a null source is a source of its own, the last. An empty
    table gives no rows. Rows sharing a doc_id are rows of their own; equal rows
    may swap their places, which gives the same set of rows.
    """
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count("text").alias("size"), F.lit(0).alias("_row")
    )
    return plan(sizes, weights, share_percent, seed).select("doc_id", "size", "source_size", "target", "taken")


def plan(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, seed: int = 17
) -> DataFrame:
    """The mix of a table with doc_id, source, size and a key `_row`, with all that is needed to cut texts.

    `_times` whole copies are taken, and of one more the `_part` words that stand in
    picked blocks of `_block` words and are among the shard's first `_rest` such words;
    the row's first word is the shard's word `_from`.
    """
    sizes = store(sizes.select("doc_id", "source", "size", "_row"), "sizes")
    targets = store(source_targets(sizes, weights, share_percent), "targets")
    # One row per source: Spark picks the join by their measured size.
    sharded = _with_parent(sizes, targets, ["source"]).select(
        "doc_id", "source", "size", "_row", "source_size", "target",
        F.pmod(F.xxhash64(row_id(), F.lit(seed)), F.ceil(F.col("n_docs") / SHARD_DOCS)).alias("_shard"),
    )
    shards = store(
        sharded.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"))
        .withColumn("_region", F.expr(f"_shard div {REGION_SHARDS}")),
        "shards",
    )
    wanted = targets.agg(F.sum("target")).first()[0] or 0.0
    by_source = apportion(
        targets.select("source", "target", F.lit(round(wanted)).cast("bigint").alias("_all"), F.lit(0).alias("_mix")),
        ["_mix"], "source", "_all", "target", "_source_quota",
    )
    by_region = apportion(
        _with_parent(
            shards.groupBy("source", "_region").agg(F.sum("_shard_size").alias("_region_size")),
            by_source.select("source", "_source_quota"), ["source"],
        ),
        ["source"], "_region", "_source_quota", "_region_size", "_region_quota",
    )
    by_shard = apportion(
        _with_parent(shards, by_region.select("source", "_region", "_region_quota"), ["source", "_region"]),
        ["source", "_region"], "_shard", "_region_quota", "_shard_size", "_shard_quota",
    )
    quotas = store(by_shard.select("source", "_shard", "_shard_size", "_shard_quota"), "quotas")
    order = Window.partitionBy("source", "_shard").orderBy(
        F.xxhash64(row_id(), F.lit(seed + 1)), "doc_id", "size", "_row"
    ).rowsBetween(Window.unboundedPreceding, 0)
    placed = sharded.withColumn("_from", F.sum("size").over(order) - F.col("size"))
    # Quotas are words, and shares are whole words, so only a source's rounding can put one above this.
    quota = F.least(F.col("_shard_quota"), F.col("_shard_size") * MAX_REPEATS)
    words = F.greatest(F.col("_shard_size"), F.lit(1))
    cut = quotas.select(
        "source", "_shard", F.floor(quota / words).alias("_times"), (quota % words).alias("_rest"),
        F.greatest(F.floor(words / BLOCKS_PER_SHARD), F.lit(1)).alias("_block"), words.alias("_words"),
    ).withColumn("_blocks", F.ceil(F.col("_words") / F.col("_block"))).withColumn(
        "_phase", F.pmod(F.xxhash64("source", "_shard", F.lit(seed + 2)), F.col("_blocks"))
    )
    # The shard's last block may be short. It is picked if the phase is below the number of blocks; one more makes up for it.
    least = F.ceil(F.col("_rest") / F.col("_block"))
    cut = cut.withColumn(
        "_quota", F.least(F.col("_blocks"), least + F.when(F.col("_phase") < least, 1).otherwise(0))
    ).drop("_words")
    met = _with_parent(placed, cut, ["source", "_shard"])
    marks = [F.col(c) for c in ("_block", "_blocks", "_quota", "_phase")]

    def taken_before(at: Column) -> Column:
        return F.least(F.col("_rest"), picked_before(at, *marks))

    start, end = F.col("_from"), F.col("_from") + F.col("size")
    met = met.withColumn("_part", (taken_before(end) - taken_before(start)).cast("bigint"))
    return met.withColumn("taken", (F.col("_times") * F.col("size") + F.col("_part")).cast("bigint"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of the mix, with the columns of `docs`.

    A document comes as often as all of it is taken, and once more with only
    the words in picked blocks (and the blanks after them), if there are any. What the mix does not take is absent.
    """
    rows = store(docs.withColumn("_llm_row", F.monotonically_increasing_id()), "rows")
    sizes = rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count("text").alias("size"),
        F.col("_llm_row").alias("_row"),
    )
    found = plan(sizes, seed=seed).where("taken > 0").select(
        F.col("_row").alias("_llm_row"),
        F.struct("_times", "_part", "_from", "_rest", "_block", "_blocks", "_quota", "_phase").alias("_llm_plan"),
    )
    p = F.col("_llm_plan")
    copies = F.concat(
        F.array_repeat(F.lit(True), p["_times"].cast("int")),
        F.when(p["_part"] > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")),
    )
    met = rows.join(found, "_llm_row").withColumn("_llm_whole", F.explode(copies))
    words = F.regexp_extract_all(
        "text", F.lit(f"^[{BLANK}]+[^{BLANK}]+[{BLANK}]*|[^{BLANK}]+[{BLANK}]*"), F.lit(0)
    )

    marks = [p[c] for c in ("_block", "_blocks", "_quota", "_phase")]

    def picked(word, number):
        at = p["_from"] + number
        before = picked_before(at, *marks)
        return (before < p["_rest"]) & (picked_before(at + 1, *marks) > before)

    text = F.when(F.col("_llm_whole"), F.col("text")).otherwise(F.array_join(F.filter(words, picked), ""))
    return with_text(met.withColumn("_llm_text", text), docs.columns)


def _with_parent(rows: DataFrame, parent: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; keeps the keys of `rows` only."""
    keys = {c: f"_parent_{c}" for c in on}
    renamed = parent.withColumnsRenamed(keys)
    return rows.join(renamed, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()], how).drop(*keys.values())

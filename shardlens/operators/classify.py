"""Running a user's classifier over the records of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardlens.durable import store
from shardlens.functions.outcomes import no_error
from shardlens.operators.lookup import SALTS, lookup_join
from shardlens.schemas import MATCHES
from shardlens.sources.records import lines_of

# Takes the query text, the model and a frame with `uri`, `text` and any extra
# columns of the shards; returns one truth value per row. The frame holds a part
# of one shard, so an answer must not depend on other records.
Classifier = Callable[[str, str, pd.DataFrame], "pd.Series"]

FAILED_CODE = 500
ABSENT_CODE = 404
ABSENT = "shard not found"
BIG_BYTES = 256 << 20
# Lines of one part of a shard, and jobs that a part meets at once.
PART_LINES = 10_000
LIST_JOBS = 64
# Matching lines that are handed back together, about.
OUT_ROWS = 10_000
_SCORED = "job_id string, pos int, uri string, text string, failure string"


def _scorer(classifier: Classifier) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score each part of a shard for each job of its list.

    Yields the matching lines, and for every part and job one row without uri: the
    mark that the job was seen, with the failure if the classifier raised. A part's frame is built
    once; each job gets a copy whose columns are copied only if it writes to them.

    All helpers are nested, so that they travel to the workers by value and
    the package need not be installed there.
    """
    names, rows_of_batch = ("job_id", "pos", "uri", "text", "failure"), OUT_ROWS
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def truth_values(answer: object, rows: int) -> np.ndarray:
        if not isinstance(answer, (pd.Series, np.ndarray)):
            answer = pd.Series(answer)
        if len(answer) != rows:
            raise ValueError(f"{len(answer)} answers for {rows} records")
        if answer.dtype != bool:
            answer = pd.Series(answer).astype("boolean").fillna(False)
        return np.asarray(answer, dtype=bool)

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(out[n], t) for n, t in zip(names, types)], names=list(names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pd.set_option("mode.copy_on_write", True)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lines, jobs, first = row.pop("_lines"), row.pop("_jobs"), row.pop("_first")
                uris = [f"{row['doc_id']}#{n}" for n in range(first, first + len(lines))]
                part = pd.DataFrame({**row, "pos": np.arange(first, first + len(lines)), "uri": uris, "text": lines})
                for job in jobs:
                    failure, hits = None, []
                    try:
                        answer = classifier(job["query_text"], job["model"], part.copy(deep=False))
                        hits = np.flatnonzero(truth_values(answer, len(lines))).tolist()
                    except Exception as problem:  # the job fails, not the task
                        failure = f"{type(problem).__name__}: {problem}"
                    out["job_id"] += [job["job_id"]] * (len(hits) + 1)
                    out["pos"] += [None, *(first + h for h in hits)]
                    out["uri"] += [None, *(uris[h] for h in hits)]
                    out["text"] += [None, *(lines[h] for h in hits)]
                    out["failure"] += [failure, *([None] * len(hits))]
                    if len(out["pos"]) >= rows_of_batch:
                        yield batch_of(out)
                        out = {n: [] for n in names}
            yield batch_of(out)

    return score


def big_shards(sizes: DataFrame, shard_key: str, size: str = "byte_size", limit: int = BIG_BYTES) -> DataFrame:
    """Keys of the shards that are better spread over several tasks, from a catalogue or a listing.

    With many jobs on one shard, hand in size times jobs as `size`.
    """
    return sizes.where(F.col(size) > limit).select(shard_key).distinct()


def _parts(shards: DataFrame) -> DataFrame:
    """Texts in parts of some thousand lines, each with the number of its first line. No text, no part."""
    kept = [c for c in shards.columns if c != "text"]
    cut = shards.where(F.col("text").isNotNull()).withColumn("_all", lines_of("text"))
    firsts = F.sequence(F.lit(0), F.size("_all") - 1, F.lit(PART_LINES))
    return cut.withColumn("_first", F.explode(firsts)).select(
        *kept, "_first", F.slice("_all", F.col("_first") + 1, PART_LINES).alias("_lines")
    )


def _job_lists(jobs: DataFrame, shard_key: str) -> DataFrame:
    """The jobs of each shard in lists of bounded length."""
    counts = jobs.groupBy(shard_key).agg(F.ceil(F.count("*") / LIST_JOBS).alias("_lists"))
    placed = jobs.join(counts, shard_key).withColumn("_list", F.pmod(F.xxhash64("job_id"), "_lists"))
    return placed.groupBy(shard_key, "_list").agg(
        F.collect_list(F.struct("job_id", "query_text", "model")).alias("_jobs")
    ).drop("_list")


def _meet(parts: DataFrame, lists: DataFrame, shard_key: str, big: DataFrame | None) -> DataFrame:
    """Each part with each list of its shard's jobs. Parts of big shards are spread over salts, and their lists repeated."""
    if big is None:
        return parts.join(lists, shard_key).drop(shard_key)
    marks = store(big.select(shard_key, F.lit(True).alias("_big")), "big")
    salt = F.when(F.col("_big"), F.pmod(F.xxhash64("_first"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_big"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = lookup_join(parts, marks, [shard_key], ["_first"], "left").withColumn("_salt", salt)
    right = lookup_join(lists, marks, [shard_key], ["_jobs"], "left").withColumn("_salt", F.explode(salts))
    met = left.join(right.select(shard_key, "_salt", "_jobs"), [shard_key, "_salt"])
    return met.drop(shard_key, "_salt", "_big")


def _every_job(jobs: DataFrame, scored: DataFrame) -> DataFrame:
    """The scored rows, and one unseen row for every job, which alone is left if its shard is absent."""
    absent = jobs.select(
        "job_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("failure"), F.lit(0).alias("seen"),
    )
    return scored.withColumn("seen", F.lit(1)).unionByName(absent)


def classify(
    jobs: DataFrame,
    shards: DataFrame,
    classifier: Classifier,
    shard_key: str = "data_id",
    big: DataFrame | None = None,
) -> DataFrame:
    """Callbacks (job_id, error, matches) of all `jobs`, one for each.

    `jobs` has job_id, query_text, model and `shard_key`; `shards` has one row
    per `shard_key`, with doc_id, text and any columns the classifier wants to
    see. A part of a text goes to Python once for each list of jobs, not for
    each job. Shards named in `big` (column `shard_key`) have their parts and
    jobs spread over tasks. A job with any failed part is an error, and so is
    one whose shard is absent or has no text; a job without a match has an
    empty list, never longer than the lines of its one shard.
    """
    wanted = jobs.select("job_id", "query_text", "model", shard_key)
    keyed = shards if shard_key != "doc_id" else shards.withColumn("_key", F.col("doc_id"))
    key = shard_key if shard_key != "doc_id" else "_key"
    met = _meet(
        _parts(keyed), _job_lists(wanted.withColumnRenamed(shard_key, key), key), key,
        None if big is None else big.select(F.col(shard_key).alias(key)),
    )
    scored = met.mapInArrow(_scorer(classifier), _SCORED)
    found = F.when(F.col("uri").isNotNull(), F.struct("pos", F.struct("uri", "text").alias("match")))
    per_job = _every_job(wanted, scored).groupBy("job_id").agg(
        F.when(F.max("seen") == 0, ABSENT).otherwise(F.max("failure")).alias("_failure"),
        F.sort_array(F.collect_list(found)).alias("_found"),
    )
    failed = F.col("_failure").isNotNull()
    error = F.struct(
        F.when(F.col("_failure") == ABSENT, ABSENT_CODE).otherwise(FAILED_CODE).alias("code"),
        F.col("_failure").alias("message"),
    )
    return per_job.select(
        "job_id",
        F.when(failed, error).otherwise(no_error()).alias("error"),
        F.when(failed, F.array().cast(MATCHES)).otherwise(F.col("_found.match")).alias("matches"),
    )

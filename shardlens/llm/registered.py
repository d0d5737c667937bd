"""One query for each operator, over the whole table of documents, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardlens.llm import (
    bpe, clustering, convnet, language, lexical, line_dedup, minhash, mixing, quality, suffixes, syncmers, token_counts,
    token_files,
)

# Vocabulary files of public tokenizers; a parameter of every operator that reads one.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@registered
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return line_dedup.line_digests(docs, line_dedup.store_of(docs, insertions=2))


@registered
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_digests(documents(spark, folder), WORD_BPE)


@registered
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.predictions(docs, language.learn(docs, PIECES))


@registered
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_digests(documents(spark, folder), BYTE_RANKS, public_tokenizers.PATTERN)
    return found.select(bpe.back_to_doc_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@registered
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), PIECES)


@registered
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.judged(documents(spark, folder), labels)


@registered
def op7_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints_with_edits(documents(spark, folder))


@registered
def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), shingle=4, percent=80)


@registered
def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@registered
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@registered
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{folder}/embeddings.parquet"))


@registered
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@registered
def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return convnet.classified(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


# The other queries rest on tokenizers, trained models, hash-based marks or windows over bytes,
# and are tested against plain Python instead.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"


def _clusters_sql(rounds: int) -> str:
    """Lloyd's rounds written out: a{n} assigns to centroids c{n}, and c{n+1} are the new ones."""
    parts = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v AS c
            FROM kept QUALIFY cluster < 8)""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
            SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
            FROM kept, c{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if n < rounds:
            parts.append(f"""m{n} AS MATERIALIZED (
            SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c
            FROM (SELECT cluster, i, sum(x)::BIGINT AS total, count(*) AS n
                  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i)
            GROUP BY cluster)""")
            parts.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (cluster))""")
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
               (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE: dict[str, str] = {
    "op11_centroid_clusters": _clusters_sql(10),
    "op12_ranked_search": f"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
        spread AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sizes, totals),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS term FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN spread USING (doc_id)
            GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
        first AS (
            SELECT key, min(doc_id) AS doc_id FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        judged AS (
            SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.doc_id <> k.doc_id AS dropped
            FROM keyed k LEFT JOIN first f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op8_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        runs AS (
            SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sets AS (SELECT DISTINCT doc_id, shingle FROM runs),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
            WHERE 100 * common >= 80 * (s.n + t.n - common)),
        edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
}

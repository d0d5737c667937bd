"""The pipeline's stages against the same steps in plain Python."""

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from shardlens.llm import bpe, registered
from shardlens.llm.common import BATCH_ROWS, in_small_batches
from tests.llm import brute
from tests.llm.conftest import rows_of


def stages(spark, docs, folder, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    return out


def test_every_stage(spark, small, tmp_path):
    language, lines, near, mixed, encoded = stages(spark, small, "/root/testdata/sf0.001", tmp_path)
    columns = small.columns
    assert all(df.columns == columns for df in (language, lines, near, mixed))
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    assert sorted(rows(language)) == sorted(rows(small))  # all of these have a language

    kept = {d: k for d, _, _, k in brute.line_dedup(rows(language))}
    assert {d: brute.sha(t) for d, t in rows(lines)} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    groups = brute.near_duplicates(rows(lines), 5)
    assert {d for d, _ in rows(near)} == {d for d, _, _, first in groups if first}
    assert dict(rows(near)).items() <= dict(rows(lines)).items()

    texts = dict(rows(near))
    taken = {}
    for d, t in rows(mixed):
        assert t == texts[d] or set(t.split()) <= set(texts[d].split())
        taken[d] = taken.get(d, 0) + len(brute.WORD.findall(t))
    assert all(n <= 2 * len(brute.WORD.findall(texts[d])) for d, n in taken.items())
    targets = brute.mix_targets([(r.doc_id, r.source, r.text) for r in near.collect()])
    by_source = {}
    for r in near.collect():
        by_source[r.source] = by_source.get(r.source, 0) + taken.get(r.doc_id, 0)
    assert all(abs(by_source[s] - t) <= 0.02 * t + 10 for s, (_, t) in targets.items())

    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(registered.BYTE_RANKS), special_tokens={}
    )
    expected = sorted(
        (d, len(ids := plain.encode_ordinary(t)), brute.sha(",".join(map(str, ids))), brute.sha(t)) for d, t in rows(mixed)
    )
    assert sorted(map(tuple, encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected


@pytest.mark.parametrize("table", ["awkward", "empty"])
def test_stages_take_any_rows(spark, request, tmp_path, table, monkeypatch):
    """A model of the small table stands in for one that the few awkward rows could not give."""
    docs = request.getfixturevalue(table)
    if table == "awkward":
        model = corpus_pipeline.language.learn(request.getfixturevalue("small"), registered.PIECES)
        monkeypatch.setattr(corpus_pipeline.language, "learn", lambda docs, vocabulary: model)
    found = stages(spark, docs, "", tmp_path)
    assert all(df.columns == docs.columns for df in found[:4])
    if table == "awkward":
        kept = {r.doc_id for r in found[0].collect()}
        assert {1, 5, 7, 9, 10, 12} <= kept and not {2, 3, 4, 16} & kept
        assert found[4].count() == found[3].count() > 0
    else:
        assert found[4].count() == 0


def largest_batch(docs):
    """Rows of the largest batch that Python gets."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return docs.mapInArrow(sizes, "n bigint").groupBy().max("n").first()[0]


def test_small_batches_last_beyond_the_call(spark, awkward):
    """Stages return results that run later; Python gets few texts at a time then, and the session keeps its settings."""
    texts = spark.range(3000).selectExpr("id doc_id", "concat('word number ', id) text").coalesce(1)
    spark.conf.set("fs.key.of.a.store", "secret")
    before = spark.conf.getAll
    few = in_small_batches(texts)
    assert largest_batch(few) == 512 < largest_batch(texts) == 3000
    assert few.schema == texts.schema and rows_of(few, "*") == rows_of(texts, "*")
    assert rows_of(in_small_batches(awkward), "*") == rows_of(awkward, "*")
    kept = [k for k in ("spark.sql.shuffle.partitions", "fs.key.of.a.store") if few.sparkSession.conf.get(k) == before[k]]
    assert len(kept) == 2 and spark.conf.getAll == before
    spark.conf.unset("fs.key.of.a.store")
    assert largest_batch(in_small_batches(few, 100)) == 100 and largest_batch(in_small_batches(few)) == 512


@pytest.mark.parametrize("number", [0, 4])
def test_stages_of_whole_texts_take_small_batches(spark, small, number):
    _, stage = corpus_pipeline.STAGES[number]
    assert int(stage(spark, small, "").sparkSession.conf.get(BATCH_ROWS)) <= 512

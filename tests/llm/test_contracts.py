"""Every operator against brute force, on awkward rows, on the smallest table and on no rows."""

import base64
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shardlens.llm import bpe, language, line_dedup, minhash, mixing, quality, registered, suffixes, syncmers, token_counts, token_files
from tests.llm import brute
from tests.llm.conftest import pairs, rows_of


@pytest.fixture(params=["awkward", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_line_dedup(docs):
    found = line_dedup.line_digests(docs, line_dedup.store_of(docs))
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(pairs(docs))


def test_token_files(docs):
    tokenizer = Tokenizer.from_file(registered.WORD_BPE)
    tokenizer.encode_special_tokens = True
    start, expected = 0, []
    for doc_id, text in sorted(pairs(docs), key=lambda r: (brute.key_id(r[0]), r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    found = token_files.token_digests(docs, registered.WORD_BPE)
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)


def test_byte_bpe(docs):
    with open(registered.BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc_id, text in pairs(docs):
        ids = plain.encode_ordinary(text or "")
        expected.append((brute.key_id(doc_id), len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")))
    found = bpe.encode_digests(docs, registered.BYTE_RANKS, public_tokenizers.PATTERN)
    assert rows_of(found, "_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)


def test_byte_bpe_decodes_what_it_encodes(awkward):
    encoded = bpe.encode_texts(awkward, registered.BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, registered.BYTE_RANKS, public_tokenizers.PATTERN)
    expected = sorted(((brute.key_id(i), (t or "").encode()) for i, t in pairs(awkward)), key=str)
    assert sorted(((r["_id"], bytes(r["bytes"])) for r in decoded.collect()), key=str) == expected


def test_token_counts(docs):
    first, rest = token_counts.read_vocabulary(registered.PIECES)

    def count(word):
        at, n = 0, 0
        while at < len(word):
            vocabulary = rest if at else first
            end = next((e for e in range(min(len(word), at + 16), at, -1) if word[at:e] in vocabulary), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    expected = []
    for doc_id, text in pairs(docs):
        counts = [count(w) for w in brute.WORD.findall(text or "")]
        expected.append((doc_id, len(counts), sum(counts) + counts.count(0), counts.count(0)))
    found = token_counts.token_counts(docs, registered.PIECES)
    assert rows_of(found, "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(expected, key=str)


def test_base_rules(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (16, 0, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    found = quality.judged(docs, labels)
    expected = sorted(((i, *brute.base_statistics(t)) for i, t in pairs(docs)), key=str)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(found, "doc_id", *columns) == expected
    assert found.where("base_failed and kept").isEmpty()


def test_edited_fingerprints(docs):
    by_id = [(i, t) for i, t in pairs(docs)]
    found = syncmers.fingerprints_with_edits(docs)
    rows = found.collect()
    assert len(rows) == len(by_id)
    if docs.where("doc_id is null").isEmpty() and docs.select("doc_id").distinct().count() == len(by_id):
        assert rows_of(found, "doc_id", "n_chars", "edited_sha256") == brute.edited_texts(by_id)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    texts = {}
    for r in rows:
        if r.doc_id is not None:
            texts.setdefault(dict(by_id)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in texts.values())


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(docs, shingle):
    found = minhash.near_duplicates(docs, shingle=shingle)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(pairs(docs), shingle)


def test_mixing(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    targets = brute.mix_targets(rows)
    found = mixing.mix(docs).collect()
    source = {(i, len(brute.WORD.findall(t or ""))): s for i, s, t in rows}
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert (r.source_size, pytest.approx(r.target)) == targets[s]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s, (_, target) in targets.items():
        assert abs(taken[s] - target) <= 0.02 * target + 10, s
    again = mixing.mix(docs)
    assert rows_of(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in found), key=str)


@pytest.mark.parametrize("length, period, cover", [(200, suffixes.PERIOD, suffixes.COVER), (20, 13, (0, 1, 3, 9))])
def test_suffix_dedup(awkward, small, length, period, cover):
    for docs in (awkward, small) if length == 200 else (awkward.where("length(text) < 9000 or text is null"),):
        options = {"length": length, "period": period, "cover": cover, "block_bytes": 20000, "bucket_bytes": 50000}
        found = suffixes.remove_repeats(docs, **options)
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert rows_of(found, *columns) == brute.repeated_bytes(pairs(docs), length)


def test_language(small, awkward):
    model = language.learn(small, registered.PIECES)
    found = {r.doc_id: r for r in language.predictions(small, model).collect()}
    truth = {r.doc_id: r.lang for r in small.collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in found if found[i].held_out} == set(held)
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    strange = {r.doc_id: r for r in language.predictions(awkward, model).collect() if r.doc_id is not None}
    assert all((strange[i].lang_pred, strange[i].score) == ("und", 0.0) for i in (2, 3, 4, 16))
    assert strange[10].lang_pred in model.languages
    kept = language.known_language(small, model)
    assert kept.count() == len(found) and kept.columns == small.columns


def test_language_of_one_word_is_the_sum_over_segmentations():
    model = language.fit({"x": {"▁abc": 1}, "y": {"▁cba": 2}}, {"x": 1, "y": 1}, sorted({"▁", "a", "b", "c", "ab", "bc", "▁a", "cb"}))
    pieces = {p: model.probabilities[i] for i, p in enumerate(model.pieces)}

    def total(word):
        if not word:
            return 1.0
        return sum(pieces[word[:n]] * total(word[n:]) for n in range(1, len(word) + 1) if word[:n] in pieces)

    import numpy as np

    assert np.exp(model.score_words(["▁abcb"])[0]) == pytest.approx(total("▁abcb"))


def test_no_rows(empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    results = [
        line_dedup.line_digests(empty, line_dedup.store_of(empty)),
        token_files.token_digests(empty, registered.WORD_BPE),
        language.predictions(empty, language.learn(empty, registered.PIECES)),
        bpe.encode_digests(empty, registered.BYTE_RANKS, public_tokenizers.PATTERN),
        token_counts.token_counts(empty, registered.PIECES),
        quality.judged(empty, labels),
        syncmers.fingerprints_with_edits(empty),
        minhash.near_duplicates(empty),
        mixing.mix(empty),
        mixing.mixed_documents(empty),
        suffixes.remove_repeats(empty),
    ]
    assert all(r.collect() == [] for r in results)

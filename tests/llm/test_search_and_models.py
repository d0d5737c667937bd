"""Centroid clusters, ranked search and the byte network against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from shardlens.llm import clustering, convnet, language, lexical, minhash, registered, token_files
from tests.llm import brute
from tests.llm.conftest import pairs

VECTOR = "vec_id bigint, embedding array<float>, label int, key bigint, block bigint, cluster int, points string"


def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept = [(i, [max(-clustering.LARGEST, min(clustering.LARGEST, x)) for x in v]) for i, v in kept]
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, mine, _) in zip(kept, found) if mine == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = Counter()
    for _, c, far in found:
        inertia[c] += far
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, far, inertia[c], sum(inertia.values()), sha[c]) for i, c, far in found), key=str)


def rows_with_vectors():
    draw = np.random.default_rng(5)
    middles = draw.normal(0, 1, (12, 64))
    rows = [(int(i), (middles[i % 12] + draw.normal(0, 0.6, 64)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a group of equal vectors
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, [0.0] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63)]
    rows += [(2005, [float("nan")] + [1.0] * 63), (2006, [float("inf")] + [1.0] * 63), (2007, [1e30] + [-1e30] + [0.0] * 62)]
    return rows


@pytest.mark.parametrize("n", [1211, 40, 5, 1])
def test_clusters_of_brute_force(spark, n):
    rows = rows_with_vectors()[-n:]
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3, "p") for i, v in rows], VECTOR).repartition(3)
    found = clustering.clustered(df)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows)


def test_clusters_of_an_empty_table(spark):
    assert clustering.clustered(spark.createDataFrame([], VECTOR)).collect() == []


def test_few_vectors_are_scanned_again(spark, monkeypatch):
    """Heaps leave most vectors alone, several blocks and buckets give the same, and no round shuffles points."""
    monkeypatch.setattr(clustering, "BLOCK", 64)
    monkeypatch.setattr(clustering, "BUCKET_VECTORS", 200)
    rows = rows_with_vectors()[:1200]
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3, "p") for i, v in rows], VECTOR)
    vectors = clustering.whole_vectors(df)
    found = clustering.cluster(vectors, clustering.first_centroids(vectors), rounds=10)
    assert found.scanned[0] == len(rows) and found.scanned[-1] < 0.5 * len(rows)
    assert sorted((r["key"], r["cluster"], r["distance"]) for r in found.assigned.collect()) == sorted(
        r[:3] for r in brute_clusters(rows)
    )


def test_rounds_join_without_a_shuffle(spark):
    tables = clustering.BucketedTables(spark, 100_000)
    df = spark.createDataFrame([(i, i % 5, [0.5] * 64) for i in range(100)], "vec_id bigint, key bigint, embedding array<float>")
    vectors = clustering.whole_vectors(df)
    start = np.zeros((3, 64), np.int64)
    blocks = tables.write(clustering.in_blocks(vectors).repartition(tables.buckets, "block"), "blocks")
    heaps = tables.write(clustering.assigned_first(blocks, start), "heaps")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = clustering.reassigned(blocks, heaps, start, np.ones(3))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.forget()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_ranked(docs, items, k=10):
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(1 for _, c in split if c)
    n_terms = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for doc_id, c in split:
            n, score = sum(c.values()), 0
            if n:
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                for t in set(TERM.findall((text or "").translate(LOWER))):
                    if c[t]:
                        w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


ITEMS = [
    (1, "word4x2 Word5x5 paragraph TEXT"), (1, "one two"), (2, None), (3, ""), (4, "absent words only"),
    (None, "ein SATZ mit wörtern"), (5, "x y z end"), (6, " ".join(f"word{i}x{i % 7} w{i}" for i in range(90)) * 30),
]


def item_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id bigint, text string, rank int, score bigint")


def test_ranked_search_of_brute_force(spark, awkward):
    found = lexical.ranked(awkward, item_table(spark, ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranked(pairs(awkward), ITEMS)


@pytest.mark.parametrize("dense,terms,group", [(1 << 21, 1 << 14, 8 << 20), (1 << 12, 40, 500)])
def test_ranked_search_of_real_items(spark, small, monkeypatch, dense, terms, group):
    """Equal to brute force with one block and group and with many, copies of documents included."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = small.unionByName(small.limit(60).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    monkeypatch.setattr(lexical, "DENSE", dense)
    parts = [g for g in lexical.item_groups(items, group)]
    assert (len(parts) > 1) == (group == 500) and sum(len(g.ids) for g in parts) == items.count()
    rows = []
    for part in parts:
        found = lexical.search_group(docs, part)
        rows += [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()]
    assert sorted(rows, key=str) == brute_ranked(pairs(docs), [(r["item_id"], r["text"]) for r in items.collect()])


def test_pruned_pairs_of_nodes_are_not_scored():
    """Documents without an item's rare term are never scored once enough hold it."""
    draw = np.random.default_rng(2)
    items = lexical.Items(list(range(40)), [[0, 10 + i] for i in range(40)], {bytes([i]): i for i in range(50)})
    weights = np.full(50, 3000)
    weights[0] = 1
    search = lexical.Search(items, lexical.Corpus(20_000, 2_000_000, weights))
    plain = lexical.Best(40, 10)
    for low in range(0, 20_000, 2000):
        terms = [[0] + ([10 + int(draw.integers(40))] if i % 4 == 0 else []) for i in range(2000)]
        flat = np.array([t for own in terms for t in own], np.int64)
        rows = np.repeat(np.arange(2000), [len(own) for own in terms])
        ids = list(range(low, low + 2000))
        search.add(ids, [100] * 2000, rows, flat, np.ones(len(flat), np.int64))
        for i, own in zip(ids, terms):
            one = 1_000_000_000 // (1000 + 8 * 100)
            for t in range(40):
                score = one * (1 + 3000 * (10 + t in own))
                if score >= plain.least[t]:
                    plain.add(t, np.array([score]), [i])
    assert search.best.rows == plain.rows
    assert search.pairs < 0.5 * 40 * 20_000


def test_no_items_and_no_documents(spark, empty, small):
    assert lexical.ranked(small, item_table(spark, [])).collect() == []
    assert lexical.ranked(empty, item_table(spark, ITEMS)).collect() == []
    assert lexical.ranked(small, item_table(spark, [(1, None), (2, "!!")])).collect() == []


def naive_score(network, text):
    data, cells = list(text), -(-len(text) // convnet.CELL)
    means = []
    for chunk in range(max(cells - 1, min(cells, 1))):
        total, top, n = np.zeros(convnet.FILTERS), np.zeros(convnet.FILTERS), 0
        for start in range(chunk * convnet.CELL, min(len(data), (chunk + 2) * convnet.CELL), convnet.STRIDE):
            window = (data[start:start + convnet.WIDTH] + [convnet.PAD] * convnet.WIDTH)[:convnet.WIDTH]
            response = np.maximum(network.bias + sum(network.tables[j, s] for j, s in enumerate(window)), 0)
            total, top, n = total + response, np.maximum(top, response), n + 1
        means.append(np.concatenate([total / n, top]))
    top = np.max([np.maximum(m @ network.mix + network.mix_bias, 0) for m in means], axis=0) if means else np.zeros(convnet.HIDDEN)
    return 1 / (1 + math.exp(-(top @ network.out + network.out_bias[0])))


TEXTS = [b"", b"a", b"abcdefgh" * 5, bytes(range(256)) * 3, b"x" * 128, b"y" * 129, b"Some words here. " * 400, "äöü ß".encode() * 50]


def test_network_of_plain_loops():
    network = convnet.Network.random(3)
    network.bias += 0.1
    network.mix_bias -= 0.05
    assert network.scores(TEXTS) == pytest.approx([naive_score(network, t) for t in TEXTS], abs=1e-5)
    assert network.scores([TEXTS[6]])[0] == network.scores(TEXTS)[6]
    assert len(network.scores([])) == 0


def test_gradients_are_slopes():
    network = convnet.Network.random(4)
    for x in network.parameters():
        x += np.random.default_rng(1).normal(0, 0.05, x.shape).astype(np.float32)
    network.tables[:, convnet.PAD] = 0
    labels = np.array([0, 1, 0, 1, 1, 0, 1, 0], float)
    _, grads = network.gradients(TEXTS, labels)
    loss = lambda: network.gradients(TEXTS, labels)[0]
    for x, g in zip(network.parameters(), grads):
        for at in np.argsort(np.abs(g).ravel())[-3:]:
            place, step = np.unravel_index(at, x.shape), 2e-3
            was = x[place]
            x[place] = was + step
            up = loss()
            x[place] = was - step
            down = loss()
            x[place] = was
            assert (up - down) / (2 * step) == pytest.approx(g[place], rel=0.1, abs=2e-3)


def test_held_out_quality(spark):
    """Held-out documents of both labels are told apart, though labels of these rows are never read."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    texts, values = convnet.training_sample(docs, labels)
    assert len(texts) <= 1.2 * convnet.TRAIN_DOCS and sum(map(len, texts)) <= convnet.TRAIN_BYTES
    found = convnet.classified(docs, labels).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r for r in found if not r["quality"]], [r for r in found if r["quality"]]
    assert len(bad) > 50 and len(good) > 400
    assert sum(not r["predicted"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_classifier_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (4, 0), (9, 1), (9, 0), (None, 1), (7, None), (16, 0), (13, 1), (99, 1)], "doc_id bigint, quality int"
    )
    rows = convnet.classified(awkward, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in pairs(awkward))
    assert len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in convnet.classified(awkward, labels.limit(0)).collect())
    assert convnet.classified(empty, labels).collect() == []


def test_texts_of_no_language_go(spark, small):
    """Gibberish goes by its likelihood, long or short texts of learned languages stay."""
    model = language.learn(small, registered.PIECES)
    draw = np.random.default_rng(1)
    noise = " ".join("".join(draw.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60))
    sound = [(r["doc_id"], r["text"]) for r in small.where("text is not null").collect()]
    short = [(10_000 + i, t.split(". ")[0]) for i, t in sound]
    odd = [(-1, noise), (-2, "zzxq " * 400), (-3, None), (-4, ""), (-5, "12 !!")]
    table = spark.createDataFrame(sound + short + odd, "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in language.known_language(table, model).collect()}
    letters = {i for i, t in sound + short if language.has_letter(t)}
    assert kept == letters


def changed_copies(draw, base, n, words, most):
    """Copies of `base` with words replaced by a few others, removed or cut off at either end."""
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(draw.integers(most))):
            at = int(draw.integers(len(own)))
            own[at:at + 1] = [words[int(draw.integers(len(words)))]] if draw.random() < 0.8 else []
        if draw.random() < 0.2:
            own = own[int(draw.integers(len(own) // 4)):]
        if draw.random() < 0.2:
            own = own[:len(own) - int(draw.integers(len(own) // 4))]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("common", [True, False])
def test_links_in_large_groups_of_near_copies(spark, common):
    """Every link of a group with changes from a small vocabulary is found, with a common base and with none in the table."""
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(6)]
    base = [f"b{i}" for i in range(90)]
    texts = changed_copies(draw, base, 250, words, 9) + changed_copies(draw, base[:60] + [f"c{i}" for i in range(30)], 50, words, 6)
    if common:
        texts.insert(0, " ".join(base))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = minhash.near_duplicates(docs, shingle=3, bands=64, rows=2)
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    expected = brute.near_duplicates(rows, 3)
    assert len({c for _, _, c, _ in expected}) > 20
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == expected


def test_ids_of_special_strings_are_the_librarys():
    """Word memory against an unchanged tokenizer, with special strings anywhere and in any case."""
    tokenizer, encoder = Tokenizer.from_file(registered.WORD_BPE), token_files.WordEncoder(registered.WORD_BPE)
    texts = [
        "", "<|endoftext|>", "a <|endoftext|>b", "one<|startoftext|>two<|endoftext|><|endoftext|> three.",
        "<|ENDOFTEXT|> is text", "x <|endoftext|>\n\t<|EndOfText|> y", "<|endoftext", "|> <|startoftext|>!", "don't <|endoftext|>'s",
    ]
    for text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_go_to_the_tokenizer_together_and_used_ones_stay():
    """Words before any symbols are split, words of many texts share one, and a full memory keeps what was used last."""
    tokenizer, encoder = Tokenizer.from_file(registered.WORD_BPE), token_files.WordEncoder(registered.WORD_BPE, cached_words=50)
    counted = encoder.tokenizer = Counted(encoder.tokenizer)

    def agree(texts):
        got = [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    stems = [a + b for a in ("süß", "thing", "é", "or") for b in ("ab", "cd", "ef", "gh", "kl")]
    agree([" ".join(s + m for s in stems for m in ("###", "&&&", "!!", ".***"))])
    assert counted.texts < 10  # 80 words, of which each went alone
    agree(["often " + " ".join(stems[:10])])
    counted.texts = 0
    agree(["often " + " ".join(stems[:10])] * 3)
    assert counted.texts == 0
    # Letters that are more than a letter when lowered, contractions, marks inside, blanks beyond ASCII, no words.
    agree(["İ!! xİ, don't 's 'll's re's, süß's a''s o'ıve", "é!! x́, a b　c. \x1c\x85", "", " \t\n", "x'", "ŉ! ½. 12a!! \U0001F600,"])

"""Ranked lexical search of many items at once, by dual-tree search.

A document is a vector with a coordinate for each term: the term's weight times
what its occurrences are worth in that document. An item is the set of its terms, and
a score is the sum of the document's coordinates over that set.

Documents of a batch stand in a hierarchy whose nodes hold the largest value of
each coordinate; items stand in one whose nodes hold the union of their terms.
The sum of a document node's maxima over an item node's terms bounds every score
between the two. If it is below the weakest kth score of the node's items, the whole
pair of nodes is left out; nothing else is, so results are exact. Nodes with
larger bounds are visited first, which raises the kth scores early.

Items are the stated query set. They travel in groups of bounded size; documents are
read once a group, and what comes back is k documents an item and task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shardlens.durable import store
from shardlens.llm.common import arrow_schema, columns_of, to_batch

TOP = 10
# Bytes of item texts that travel to tasks together; more items are searched in several passes.
GROUP_BYTES = 8 << 20
# Terms of a block of items, and numbers in a block of documents by terms.
BLOCK_TERMS = 1 << 14
DENSE = 1 << 21
DOC_LEAF, ITEM_LEAF, FAN = 32, 8, 8
# Sums of so many coordinates are exact in doubles.
EXACT_TERMS = 1 << 16

POSTINGS = "kind int, doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
DOCUMENT, TOTALS = 0, 1
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"

# Every ASCII byte but digits and letters parts terms; A-Z become a-z.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Items:
    """Items with their distinct terms as numbers in `vocabulary`."""

    ids: list[int | None]
    terms: list[list[int]]
    vocabulary: dict[bytes, int]
    first: int = 0


def item_groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[Items]:
    """Every item, in groups of about `group_bytes` of text; an item of more is a group of its own."""
    group, size, first = Items([], [], {}), 0, 0
    for row in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        more = len((row["text"] or "").encode())
        if group.ids and size + more > group_bytes:
            yield group
            first += len(group.ids)
            group, size = Items([], [], {}, first), 0
        vocabulary = group.vocabulary
        group.ids.append(row["item_id"])
        group.terms.append([vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(row["text"]))])
        size += more
    if group.ids:
        yield group


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Occurrences of the vocabulary's terms in every whole text, and totals of each batch of rows.

    A DOCUMENT row has the number of all its terms and those of the vocabulary
    with their counts. A TOTALS row has, in the same columns, the number of documents
    with a term, the number of all terms, and the number of documents of each term.
    """
    fields = arrow_schema(docs.sparkSession, POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.keys()
        for batch in batches:
            rows, holding, with_terms, length = [], Counter(), 0, 0
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text")):
                words = terms_of(text)
                counts = Counter(words)
                hits = [(vocabulary[t], counts[t]) for t in asked & counts.keys()]
                with_terms += bool(words)
                length += len(words)
                if hits:
                    numbers = [t for t, _ in hits]
                    holding.update(numbers)
                    rows.append((DOCUMENT, doc_id, len(words), numbers, [n for _, n in hits]))
            rows.append((TOTALS, with_terms, length, list(holding), list(holding.values())))
            yield to_batch(rows, fields)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


@dataclass
class Corpus:
    """Number of documents with a term, of all terms, and the weight of each term of a vocabulary (0: no use)."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def statistics(found: DataFrame, vocabulary_size: int) -> Corpus:
    """From the TOTALS rows; the driver gets a number for each term of the items."""
    totals = found.where(F.col("kind") == TOTALS)
    n_docs, n_terms = totals.agg(F.sum("doc_id"), F.sum("n")).first()
    each = totals.select(F.explode(F.arrays_zip("terms", "tf")).alias("t")).groupBy("t.terms").agg(F.sum("t.tf").alias("df"))
    weights = np.zeros(vocabulary_size, np.int64)
    for row in each.toLocalIterator():
        weights[row["terms"]] = math.floor(1000 * math.log((2 * (n_docs or 0) + 2) / (2 * row["df"] + 1)))
    return Corpus(n_docs or 0, n_terms or 0, weights)


class ItemTree:
    """A block of items in a hierarchy; a node has a range of items and the union of their terms."""

    def __init__(self, numbers: list[int], terms: list[list[int]]):
        # Items that begin with the same frequent terms stand together.
        spread = Counter(t for own in terms for t in own)
        ordered = [sorted(own, key=lambda t: (-spread[t], t)) for own in terms]
        order = sorted(range(len(numbers)), key=lambda i: [(-spread[t], t) for t in ordered[i]])
        self.numbers = np.array([numbers[i] for i in order], np.int64)
        self.columns = np.array(sorted(spread), np.int64)
        place = {t: i for i, t in enumerate(self.columns.tolist())}
        own = [np.array([place[t] for t in ordered[i]], np.int64) for i in order]
        kind = np.float64 if max(map(len, own), default=0) <= EXACT_TERMS else np.int64
        self.kind = kind
        # node: (low, high, children, terms of the node, items of a leaf by its terms)
        nodes = []
        for low in range(0, len(own), ITEM_LEAF):
            part = own[low:low + ITEM_LEAF]
            union = np.unique(np.concatenate(part))
            held = np.zeros((len(union), len(part)), kind)
            for i, mine in enumerate(part):
                held[np.searchsorted(union, mine), i] = 1
            nodes.append((low, low + len(part), None, union, held))
        while len(nodes) > 1:
            nodes = [
                (part[0][0], part[-1][1], part, np.unique(np.concatenate([n[3] for n in part])), None)
                for part in (nodes[i:i + FAN] for i in range(0, len(nodes), FAN))
            ]
        self.root = nodes[0]


def item_trees(items: Items, weights: np.ndarray, block_terms: int = BLOCK_TERMS) -> list[ItemTree]:
    """Trees over items of about `block_terms` distinct terms each; terms without weight and items without terms are left out."""
    trees, numbers, terms, seen = [], [], [], set()
    for number, own in enumerate(items.terms):
        own = [t for t in own if weights[t] > 0]
        if not own:
            continue
        if numbers and len(seen.union(own)) > block_terms:
            trees.append(ItemTree(numbers, terms))
            numbers, terms, seen = [], [], set()
        numbers.append(number)
        terms.append(own)
        seen.update(own)
    if numbers:
        trees.append(ItemTree(numbers, terms))
    return trees


class DocumentTree:
    """Documents (rows of coordinates) in a hierarchy; levels[0] are leaves, every level holds coordinate maxima."""

    def __init__(self, values: np.ndarray):
        strongest = values.argmax(axis=1)
        self.order = np.lexsort((-values.max(axis=1), strongest))
        self.values = values[self.order]
        self.levels = [np.maximum.reduceat(self.values, np.arange(0, len(values), DOC_LEAF), axis=0)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))


class Best:
    """The k best documents of each item so far: larger scores, then smaller doc_ids, null last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
        # What a score must reach to matter.
        self.least = np.ones(n)

    def add(self, item: int, scores: np.ndarray, ids: list[int | None]) -> None:
        rows = self.rows[item]
        rows += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        rows.sort()
        del rows[self.k:]
        if len(rows) == self.k:
            self.least[item] = -rows[-1][0]


class Search:
    """All items against batches of documents."""

    def __init__(self, items: Items, corpus: Corpus, k: int = TOP):
        self.corpus = corpus
        self.trees = item_trees(items, corpus.weights)
        self.best = Best(len(items.ids), k)
        self.pairs = 0

    def add(self, ids: list, lengths: list[int], rows: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Documents with their terms: `rows` says whose each of `terms` and `tf` is, in rising order."""
        n_docs, n_terms = self.corpus.n_docs, self.corpus.n_terms
        spread = np.array([10 + 90 * n * n_docs // max(1, n_terms) for n in lengths], np.int64)
        worth = self.corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * spread[rows]))
        for tree in self.trees:
            at = np.searchsorted(tree.columns, terms)
            at[at == len(tree.columns)] = 0
            mine = tree.columns[at] == terms
            of, column, value = rows[mine], at[mine], worth[mine]
            step = max(DOC_LEAF, DENSE // len(tree.columns))
            for low in range(0, len(ids), step):
                a, b = np.searchsorted(of, [low, low + step])
                if a == b:
                    continue
                present, row = np.unique(of[a:b], return_inverse=True)
                values = np.zeros((len(present), len(tree.columns)), tree.kind)
                values[row, column[a:b]] = value[a:b]
                docs = DocumentTree(values)
                names = [ids[present[i]] for i in docs.order]
                self._meet(tree, tree.root, docs, names, len(docs.levels) - 1, 0)

    def _weakest(self, tree: ItemTree, node: tuple) -> float:
        return self.best.least[tree.numbers[node[0]:node[1]]].min()

    def _meet(self, tree: ItemTree, node: tuple, docs: DocumentTree, names: list, level: int, at: int) -> None:
        """A pair of nodes that its bound could not rule out."""
        low, high, children, terms, held = node
        if level == 0 and children is None:
            self._score(tree, node, docs, names, at)
        elif children is not None and (level == 0 or high - low > ITEM_LEAF * FAN ** level):
            maxima = docs.levels[level][at]
            bounds = [maxima[child[3]].sum() for child in children]
            for i in np.argsort(bounds)[::-1].tolist():
                if bounds[i] >= self._weakest(tree, children[i]):
                    self._meet(tree, children[i], docs, names, level, at)
        else:
            first = at * FAN
            bounds = docs.levels[level - 1][first:first + FAN][:, terms].sum(axis=1)
            for i in np.argsort(bounds)[::-1].tolist():
                if bounds[i] >= self._weakest(tree, node):
                    self._meet(tree, node, docs, names, level - 1, first + i)

    def _score(self, tree: ItemTree, node: tuple, docs: DocumentTree, names: list, at: int) -> None:
        low, _, _, terms, held = node
        first = at * DOC_LEAF
        scores = (docs.values[first:first + DOC_LEAF][:, terms] @ held).astype(np.int64)
        self.pairs += scores.size
        numbers = tree.numbers[low:low + scores.shape[1]]
        for i in np.flatnonzero((scores >= self.best.least[numbers]).any(axis=0)).tolist():
            own = np.flatnonzero(scores[:, i] >= self.best.least[numbers[i]])
            self.best.add(int(numbers[i]), scores[own, i], [names[first + j] for j in own.tolist()])


def search_group(docs: DataFrame, items: Items, k: int = TOP) -> DataFrame:
    """(item, item_id, doc_id, score, rank) of the k best documents of each item of one group."""
    found = store(postings(docs, items.vocabulary), "postings")
    corpus = statistics(found, len(items.vocabulary))
    fields = arrow_schema(docs.sparkSession, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, corpus, k)
        for batch in batches:
            ids, lengths = columns_of(batch, "doc_id", "n")
            terms = batch.column(batch.schema.get_field_index("terms"))
            sizes = np.diff(terms.offsets.to_numpy())
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (terms, batch.column(batch.schema.get_field_index("tf")))]
            search.add(ids, lengths, np.repeat(np.arange(len(ids)), sizes), flat[0].astype(np.int64), flat[1])
        rows = [
            (items.first + number, items.ids[number], None if missing else doc_id, -score)
            for number, own in enumerate(search.best.rows) for score, missing, doc_id in own
        ]
        yield to_batch(rows, fields)

    of_tasks = found.where(F.col("kind") == DOCUMENT).drop("kind").mapInArrow(run, FOUND)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return of_tasks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each row of `items`.

    Only scores above 0 count, so items without a term (null, empty, or of terms
    that no document or every document has) get no row, and no documents or items
    give an empty table. Equal scores go by doc_id, null last. Rows that share a doc_id or an
    item_id are documents or items of their own. Whole texts are read, however long.
    """
    parts = [search_group(docs, group, k) for group in item_groups(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("item_id", "rank", "doc_id", "score")

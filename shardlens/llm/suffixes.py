"""Removal of repeated byte strings by blockwise suffix sorting with difference covers.

Positions whose remainder modulo `PERIOD` lies in a difference cover are the
cover sample: for any two positions some shift below the period takes both into
the sample. So two equal strings of `LENGTH` bytes share, at one shift, a sample
suffix that agrees on its first `LENGTH - PERIOD + 1` bytes. Hashes of these bytes are
compared first, bucket by bucket: only suffixes close before a sample that occurs twice can begin a
repeated string. A hash that stands for other bytes too only adds candidates.

The candidates then are sorted exactly, one bucket of suffixes at a time. Suffixes next to each other
go as one stretch of text into the bucket of the least `GRAM` bytes (by hash) of their strings,
where all equal strings meet. A bucket ranks its own cover sample, the positions that three does
not divide, by their first `LENGTH - 2` bytes: by a few bytes, and then in doubling steps by pairs of ranks that are
known. Any two suffixes have a shift of at most two bytes that takes both into this sample, so these bytes and the
ranks there order them however long they tie; equal ones are repeats. So a task holds one
bucket's stretches, and the ranks of one slice of them in place of longer strings. Documents stand in blocks by a digest of
their text; equal texts meet there and are handled once. A bucket answers each block with places of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardlens.llm.common import arrow_schema, columns_of, give_back_memory, to_batch

LENGTH = 200
# A perfect difference set; all remainders of 133 are differences of two of these.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
# Bytes of text in one block, and bytes of text whose suffixes go into one bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
# Positions named at a time; texts of any length are taken in such parts.
PART = 1 << 18
# Texts up to this size have blocks and buckets of the sizes above. Beyond, both grow with the root of the
# size, so that a block's rows for its buckets stay in proportion to its text.
PLAIN_BYTES = 32 << 30
COVER_NAME_BYTES = 4
DIGEST_BYTES = 16
# Slices of a bucket's stretches, sorted one after the other.
SLICES = 8
# Bytes of the runs whose least one chooses the bucket in which strings are sorted.
GRAM = 32

BLOCKS = "block int, digest binary, text binary, n bigint"
NAMES = "bucket int, block int, names binary, docs binary, counts binary, steps binary, marks binary"
STRINGS = "bucket int, block int, strings binary, runs binary, docs binary, counts binary, steps binary"
PLACES = "block int, docs binary, counts binary, steps binary"
RESULT = "digest binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

_FACTOR = 0x9E3779B97F4A7C15


class Namer:
    """64-bit names of all strings of one length in a text."""

    def __init__(self, length: int):
        self.length = length
        self.powers = self._powers(_FACTOR, PART + length)
        self.inverse = self._powers(pow(_FACTOR, -1, 1 << 64), PART + 1)
        self.values = np.random.default_rng(length).integers(1, 1 << 63, 256, dtype=np.uint64)

    @staticmethod
    def _powers(factor: int, n: int) -> np.ndarray:
        out = np.full(n, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def names(self, data: bytes, start: int) -> np.ndarray:
        """Names of the strings that begin at `start` and after, PART at most, as far as they fit."""
        part = np.frombuffer(data, np.uint8)[start:start + PART + self.length - 1]
        n = len(part) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.values[part] * self.powers[:len(part)], out=sums[1:])
        h = (sums[self.length:] - sums[:n]) * self.inverse[:n]
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, one plane of bytes after the other."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_places(docs: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted within documents: documents, how many places each has, steps from place to place."""
    first = np.ones(len(docs), bool)
    first[1:] = docs[1:] != docs[:-1]
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(docs)))
    return packed(docs[starts].astype(np.uint64), 4), packed(counts.astype(np.uint64), 4), packed(steps.astype(np.uint64), 4)


def unpack_places(docs: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts_, steps_ = unpacked(counts, 4).astype(np.int64), unpacked(steps, 4).astype(np.int64)
    total = np.cumsum(steps_)
    starts = np.cumsum(counts_) - counts_
    offset = np.where(starts > 0, total[starts - 1], 0) if len(starts) else starts
    return np.repeat(unpacked(docs, 4).astype(np.int64), counts_), total - np.repeat(offset, counts_)


def deal(block: int, docs: np.ndarray, places: np.ndarray, names: np.ndarray, buckets: int, width: int) -> Iterator[tuple]:
    """A block's names as rows of NAMES, one a bucket.

    A name that the block holds more than once is known to repeat: one copy goes
    out as a mark, and its places come back through a row without names. So a
    string in a third of all documents is one name from each block.
    """
    if not len(names):
        return
    order = np.argsort(names)
    ordered = names[order]
    equal = ordered[1:] == ordered[:-1]
    repeats = np.zeros(len(names), bool)
    repeats[order[1:][equal]] = True
    repeats[order[:-1][equal]] = True

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return ((values >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)

    if repeats.any():
        yield (block % buckets, block, b"", *pack_places(docs[repeats], places[repeats]), b"")
    marks = np.unique(names[repeats])
    docs, places, names = docs[~repeats], places[~repeats], names[~repeats]
    own, marked = bucket_of(names), bucket_of(marks)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(buckets + 1))
    mark_edges = np.searchsorted(marked, np.arange(buckets + 1))  # marks are sorted, and so are their buckets
    for b in range(buckets):
        at = order[edges[b]:edges[b + 1]]
        mine = marks[mark_edges[b]:mark_edges[b + 1]]
        if len(at) or len(mine):
            yield (b, block, packed(names[at], width), *pack_places(docs[at], places[at]), packed(mine, width))


def sort_bucket(rows: list[dict], width: int) -> Iterator[tuple]:
    """Sort the names of one bucket; answer each block with the places of repeats, as rows of PLACES."""
    own = [unpacked(r["names"], width) for r in rows]
    marks = [unpacked(r["marks"], width) for r in rows]
    names = np.concatenate([*own, *marks])
    order = np.argsort(names)
    ordered = names[order]
    equal = ordered[1:] == ordered[:-1]
    repeats = np.zeros(len(names), bool)
    repeats[order[1:][equal]] = True
    repeats[order[:-1][equal]] = True
    at = 0
    for row, mine in zip(rows, own):
        if not len(row["names"]) and len(row["steps"]):
            yield row["block"], row["docs"], row["counts"], row["steps"]
        elif (found := repeats[at:at + len(mine)]).any():
            docs, places = unpack_places(row["docs"], row["counts"], row["steps"])
            yield (row["block"], *pack_places(docs[found], places[found]))
        at += len(mine)


def cover_ranks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Ranks by their first `depth` bytes of the positions in [start, end) that three does not divide.

    Positions with fewer bytes before the end of their run have a rank of no meaning. Ranks come
    at the places of their positions; equal ones stand for equal bytes, smaller ones for smaller bytes.
    """
    at = np.repeat(starts, ends - starts) + _within(ends - starts)
    sample = at % 3 != 0
    at, room = at[sample], (np.repeat(ends, ends - starts) - at)[sample]
    have = depth if depth <= 8 else 8 - (8 - depth) % 3  # what is left after it are steps of three
    at, room = at[room >= have], room[room >= have]
    rank = np.zeros(len(text) + 1, np.int32)
    key = np.zeros(len(at), np.uint64)
    for i in range(have):
        key = key << np.uint64(8) | text[at + i]
    while len(at):
        # Those of one rank so far are parted by the key, within the range of ranks that they share.
        order = np.argsort(key)
        at, room, key, old = at[order], room[order], key[order], rank[at[order]]
        parted = np.ones(len(at) + 1, bool)
        parted[1:-1] = old[1:] != old[:-1]
        group = np.flatnonzero(parted)
        parted[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(parted)
        size = np.diff(first)
        head = np.repeat(group[:-1], np.diff(group))
        rank[at] = np.maximum(old, 1) + np.repeat(first[:-1], size) - head
        if have == depth:
            break
        step = min(have - have % 3, depth - have)
        tied = np.repeat(size > 1, size) & (room >= have + step)
        at, room = at[tied], room[tied]
        key = rank[at].astype(np.int64) << 32 | rank[at + step]
        have += step
    return rank


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def numbers_of(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """A number for each string of `length` bytes at the sorted places `at`: the same for equal bytes only.

    A place that three does not divide is in the cover sample, and its rank leaves two bytes to
    compare. One that three divides is compared with its like and with those of remainder 1 by one byte and the
    rank of the place after it, and with those of remainder 2 by two bytes and the rank after these.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.diff(at) >= length)
    text, depth = np.frombuffer(data, np.uint8), length - 2
    rank = cover_ranks(text, at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + length, depth)
    out = np.empty(len(at), np.int64)
    kind = at % 3
    in_sample, no_sample = np.flatnonzero(kind != 0), np.flatnonzero(kind == 0)

    def wide(values: np.ndarray, shift: int) -> np.ndarray:
        return values.astype(np.int64) << shift

    def by_one(places: np.ndarray) -> np.ndarray:
        return wide(text[places], 40) | wide(rank[places + 1], 8) | text[places + 1 + depth]

    def by_two(places: np.ndarray) -> np.ndarray:
        return wide(text[places], 48) | wide(text[places + 1], 40) | rank[places + 2]

    own = at[in_sample]
    _, out[in_sample] = np.unique(
        wide(rank[own], 16) | wide(text[own + depth], 8) | text[own + depth + 1], return_inverse=True
    )
    if not len(no_sample):
        return out
    _, leads, back = np.unique(by_one(at[no_sample]), return_index=True, return_inverse=True)
    lead = at[no_sample][leads]
    numbers = len(at) + np.arange(len(lead))
    for remainder, key in ((1, by_one), (2, by_two)):
        others = in_sample[kind[in_sample] == remainder]
        if len(others):
            keys, some = np.unique(key(at[others]), return_index=True)
            wanted = key(lead)
            where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            numbers = np.where(keys[where] == wanted, out[others[some[where]]], numbers)
    out[no_sample] = numbers[back]
    return out


def repeated(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers occur more than once, and which places are the first of their number."""
    _, first, back, counts = np.unique(numbers, return_index=True, return_inverse=True, return_counts=True)
    leads = np.zeros(len(numbers), bool)
    leads[first] = True
    return counts[back] > 1, leads


def least_grams(data: bytes, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The least name of `gram` bytes in each string of `length` bytes at the sorted places `at`."""
    namer, reach = Namer(gram), length - gram + 1
    out = np.empty(len(at), np.uint64)
    for start in range(0, len(data), PART):
        a, b = np.searchsorted(at, [start, start + PART])
        if b == a:
            continue
        least, width, wanted = namer.names(data, start), 1, reach
        follow = start + PART
        while len(least) < PART + reach - 1 and follow < len(data):
            least = np.append(least, namer.names(data, follow)[:PART + reach - 1 - len(least)])
            follow += PART
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        places = at[a:b] - start
        out[a:b] = np.minimum(least[places], least[places + wanted - width])
    return out


def deal_strings(block: int, texts: list[bytes], docs: np.ndarray, places: np.ndarray, buckets: int, length: int) -> Iterator[tuple]:
    """The strings at the candidates of a block as rows of STRINGS, one a bucket.

    Strings the block itself holds more than once are found here, and one copy of each goes out.
    """
    ends = np.cumsum([len(t) for t in texts])
    data = b"".join(texts)
    at = places + (ends - [len(t) for t in texts])[docs]
    known, leads = repeated(numbers_of(data, at, length))
    if known.any():
        yield (block % buckets, block, b"", b"", *pack_places(docs[known], places[known]))
    docs, places, at = docs[leads], places[leads], at[leads]
    least = least_grams(data, at, length, min(GRAM, length))
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (np.diff(docs) != 0) | (least[1:] != least[:-1])
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(at)))
    bucket = (least[heads] % np.uint64(buckets)).astype(np.int64)
    piece = (least[heads] // np.uint64(buckets) % np.uint64(SLICES)).astype(np.int64)
    order = np.lexsort((piece, bucket))
    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        runs = np.concatenate([docs[heads[some]], places[heads[some]], counts[some], piece[some]]).astype(np.uint64)
        strings = b"".join(data[a:a + n + length - 1] for a, n in zip(at[heads[some]].tolist(), counts[some].tolist()))
        yield (int(bucket[some[0]]), block, strings, packed(runs, 4), b"", b"", b"")


def sort_strings(rows: list[dict], length: int) -> Iterator[tuple]:
    """Answer each block with the places of strings whose bytes occur more than once, as rows of PLACES.

    The stretches of a bucket are sorted slice by slice; equal strings are in one slice.
    """
    for row in rows:
        if not len(row["runs"]):
            yield row["block"], row["docs"], row["counts"], row["steps"]
    rows = [r for r in rows if len(r["runs"])]
    runs = [unpacked(r["runs"], 4).astype(np.int64).reshape(4, -1) for r in rows]
    ends = [np.cumsum(counts + length - 1) for _, _, counts, _ in runs]
    for piece in range(SLICES):
        # A row has its stretches in the order of slices.
        cuts = [np.searchsorted(r[3], [piece, piece + 1]) for r in runs]
        some = [i for i, (low, high) in enumerate(cuts) if high > low]
        if not some:
            continue
        docs, places, counts, _ = np.concatenate([runs[i][:, cuts[i][0]:cuts[i][1]] for i in some], axis=1)
        data = b"".join(
            rows[i]["strings"][int(ends[i][low - 1]) if low else 0:int(ends[i][high - 1])]
            for i, (low, high) in ((i, cuts[i]) for i in some)
        )
        row = np.repeat(np.repeat(some, [cuts[i][1] - cuts[i][0] for i in some]), counts)
        within = _within(counts)
        starts = np.cumsum(counts + length - 1) - (counts + length - 1)
        found, _ = repeated(numbers_of(data, np.repeat(starts, counts) + within, length))
        row, docs, places = row[found], np.repeat(docs, counts)[found], (np.repeat(places, counts) + within)[found]
        for i in np.unique(row).tolist():
            mine = np.flatnonzero(row == i)
            mine = mine[np.lexsort((places[mine], docs[mine]))]
            yield (rows[i]["block"], *pack_places(docs[mine], places[mine]))


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [from, to) of bytes in strings of `length` that begin at sorted `starts`."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(starts) > length)
    return np.column_stack([starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)] + length])


def reached(found: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Positions below n that have one of the sorted `found` at themselves or up to `reach` after."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(np.maximum(found - reach, 0), n), 1)
    np.add.at(change, np.minimum(found + 1, n), -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def text_digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST_BYTES)


class SuffixDedup:
    """The steps over one table of documents."""

    def __init__(
        self, docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER,
        block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
    ):
        self.docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        self.spark = docs.sparkSession
        self.length, self.period, self.cover = length, period, cover
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        grown = max(1.0, (size / PLAIN_BYTES) ** 0.5)
        self.blocks = 1 + int(size / (block_bytes * grown))
        self.buckets = 1 + int(size / (bucket_bytes * grown))

    def _fields(self, schema: str) -> pa.Schema:
        return arrow_schema(self.spark, schema)

    def texts(self) -> DataFrame:
        """Texts by block; equal texts of one Arrow batch already are one row with their number."""
        fields, blocks = self._fields(BLOCKS), self.blocks

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: dict[bytes, list] = {}
                for text in columns_of(batch, "text")[0]:
                    data = text.encode()
                    key = hashlib.sha256(data).digest()[:DIGEST_BYTES]
                    seen.setdefault(key, [data, 0])[1] += 1
                yield to_batch(
                    [(int.from_bytes(k[-6:], "big") % blocks, k, data, n) for k, (data, n) in seen.items()], fields
                )

        return self.docs.select("text").mapInArrow(gather, BLOCKS)

    @staticmethod
    def distinct(table: pa.Table) -> list[tuple[bytes, bytes, int]]:
        """(digest, text, number) of a block, in order of digests: a document's number in its block is its place here."""
        found: dict[bytes, list] = {}
        for key, data, n in zip(*(table.column(c).to_pylist() for c in ("digest", "text", "n"))):
            found.setdefault(key, [data, 0])[1] += n
        return [(k, *found[k]) for k in sorted(found)]

    @staticmethod
    def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(documents, places) that buckets sent to a block, sorted by both."""
        parts = [unpack_places(*row) for row in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "steps")))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, places = (np.concatenate(a) for a in zip(*parts))
        order = np.argsort(docs << 32 | places)
        return docs[order], places[order]

    def cover_names(self, texts: DataFrame) -> DataFrame:
        depth, period, buckets, fields = self.length - self.period + 1, self.period, self.buckets, self._fields(NAMES)
        inside = np.zeros(period, bool)
        inside[list(self.cover)] = True

        def name(table: pa.Table) -> pa.Table:
            namer = Namer(depth)
            docs, places, names = [], [], []
            for number, (_, data, _) in enumerate(SuffixDedup.distinct(table)):
                if len(data) < depth + period - 1:
                    continue
                for start in range(0, len(data), PART):
                    found = namer.names(data, start)
                    at = np.flatnonzero(np.resize(np.roll(inside, -(start % period)), len(found)))
                    docs.append(np.full(len(at), number))
                    places.append(at + start)
                    names.append(found[at])
            rows = deal(
                table.column("block")[0].as_py(), *map(np.concatenate, (docs, places, names)), buckets, COVER_NAME_BYTES
            ) if docs else []
            return pa.Table.from_batches([to_batch(list(rows), fields)])

        return texts.groupBy("block").applyInArrow(name, NAMES)

    def repeats(self, names: DataFrame, width: int) -> DataFrame:
        fields = self._fields(PLACES)

        def sort(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([to_batch(list(sort_bucket(table.to_pylist(), width)), fields)])

        return names.groupBy("bucket").applyInArrow(sort, PLACES)

    def candidate_strings(self, texts: DataFrame, candidates: DataFrame) -> DataFrame:
        """The strings that begin at or close before the samples `candidates`, as stretches of text."""
        length, period, buckets, fields = self.length, self.period, self.buckets, self._fields(STRINGS)

        def cut(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                held, found = SuffixDedup.answers(right)
                texts = [data for _, data, _ in SuffixDedup.distinct(left)]
                docs, places = [], []
                for number in np.unique(held).tolist():
                    mine = found[np.searchsorted(held, number):np.searchsorted(held, number, "right")]
                    starts = reached(mine, period - 1, len(texts[number]) - length + 1)
                    docs.append(np.full(len(starts), number))
                    places.append(starts)
                block = left.column("block")[0].as_py()
                rows = list(deal_strings(block, texts, np.concatenate(docs), np.concatenate(places), buckets, length))
                give_back_memory()
            return pa.Table.from_batches([to_batch(rows, fields)])

        return texts.groupBy("block").cogroup(candidates.groupBy("block")).applyInArrow(cut, STRINGS)

    def sorted_strings(self, strings: DataFrame) -> DataFrame:
        """The places of strings that occur more than once."""
        length, fields = self.length, self._fields(PLACES)

        def sort(table: pa.Table) -> pa.Table:
            rows = to_batch(list(sort_strings(table.to_pylist(), length)), fields)
            give_back_memory()
            return pa.Table.from_batches([rows])

        return strings.groupBy("bucket").applyInArrow(sort, PLACES)

    def removed(self, texts: DataFrame, repeats: DataFrame) -> DataFrame:
        """One row of RESULT for each distinct text."""
        length, fields = self.length, self._fields(RESULT)

        def remove(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            held, found = SuffixDedup.answers(right)
            for number, (key, data, n) in enumerate(SuffixDedup.distinct(left) if left.num_rows else []):
                if n > 1 and len(data) >= length:
                    spans = np.array([[0, len(data)]])
                else:
                    spans = covered(found[np.searchsorted(held, number):np.searchsorted(held, number, "right")], length)
                kept, at = [], 0
                for start, end in spans.tolist():
                    kept.append(data[at:start])
                    at = end
                rest = b"".join([*kept, data[at:]])
                rows.append((key, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            return pa.Table.from_batches([to_batch(rows, fields)])

        return texts.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(remove, RESULT)

    def run(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row.

        Spark shuffles the texts once, by block, and uses that three times. A
        null text is empty; rows count as documents of their own even if they share a doc_id.
        """
        texts = self.texts()
        candidates = self.repeats(self.cover_names(texts), COVER_NAME_BYTES)
        repeats = self.sorted_strings(self.candidate_strings(texts, candidates))
        result = self.removed(texts, repeats)
        named = self.docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
        return named.join(result, "digest").drop("digest")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    return SuffixDedup(docs, **options).run()

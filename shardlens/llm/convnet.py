"""Quality of a text by a convolutional network over its bytes, in numpy.

Filters look at windows of a few bytes, each a table of weights by place and byte, so
that a window's response is a sum of looked-up rows. Chunks overlap by half and
together cover the whole document; a chunk has the mean and the largest response of
each filter. Hidden units combine these, the largest value of each unit over all
chunks is taken, and those are combined into one probability.

Training is stochastic descent over a sample of labelled documents that is bounded in
rows and bytes; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardlens.llm.common import arrow_schema, columns_of, row_id

WIDTH, STRIDE = 8, 2
FILTERS, HIDDEN = 24, 16
# A chunk is two neighbouring cells of so many bytes.
CELL = 128
# Labelled documents to train on: at most about so many, of so many bytes together.
TRAIN_DOCS = 6000
TRAIN_BYTES = 10 << 20
EPOCHS, BATCH, RATE = 6, 8, 0.02
# Filters learn at this share of the rate: rare bytes are seen too seldom to trust them sooner.
FILTER_PACE = 0.03
THRESHOLD = 0.3
# Cells that are looked up at a time.
SLAB = 1024
# Texts are scored in groups of about so many bytes.
GROUP_BYTES = 4 << 20
PAD = 256

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out() -> Column:
    """Rows that labels are not learned from; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


class Layout:
    """Texts laid out in cells: symbols with padding, windows that begin in a text, chunks of each text."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        cells = -(-lengths // CELL)
        self.first_cell = np.concatenate([[0], np.cumsum(cells)])
        n_cells = int(self.first_cell[-1])
        symbols = np.full(n_cells * CELL + WIDTH, PAD, np.int16)
        valid = np.zeros(n_cells * CELL, bool)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        own = np.repeat(self.first_cell[:-1] * CELL - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        at = np.arange(len(joined)) + own
        symbols[at] = joined
        valid[at] = True
        # A window that would reach into the next text sees padding there.
        self.symbols = symbols
        self.ends = np.repeat(self.first_cell[:-1] * CELL + lengths, cells)
        self.valid = valid[::STRIDE].reshape(n_cells, CELL // STRIDE)
        # Chunks: each pair of neighbouring cells of a text, or its only cell.
        chunks = np.where(cells > 1, cells - 1, cells)
        self.first_chunk = np.concatenate([[0], np.cumsum(chunks)])
        number = np.arange(int(self.first_chunk[-1])) - np.repeat(self.first_chunk[:-1], chunks)
        self.left = np.repeat(self.first_cell[:-1], chunks) + number
        self.right = np.minimum(self.left + 1, np.repeat(self.first_cell[1:], chunks) - 1)
        windows = self.valid.sum(axis=1)
        self.windows = (windows[self.left] + np.where(self.right > self.left, windows[self.right], 0)).astype(np.float32)
        self.n_cells = n_cells

    def window_symbols(self, cells: np.ndarray) -> np.ndarray:
        """(cells, windows, WIDTH) symbols; those past the end of the cell's own text are padding."""
        start = (cells[:, None] * CELL + np.arange(0, CELL, STRIDE)[None, :])[:, :, None] + np.arange(WIDTH)[None, None, :]
        return np.where(start < self.ends[cells][:, None, None], self.symbols[start], PAD)


@dataclass
class Network:
    """tables (WIDTH, 257, FILTERS), filter bias, chunk layer (means and maxima, HIDDEN), its bias, output weights and bias."""

    tables: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def random(cls, seed: int = 1, share: float = 0.5) -> Network:
        draw = np.random.default_rng(seed)
        tables = draw.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        tables[:, PAD] = 0
        return cls(
            tables, np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32), draw.normal(0, 0.3, HIDDEN).astype(np.float32),
            np.array([np.log(share / (1 - share))], np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.mix, self.mix_bias, self.out, self.out_bias]

    def responses(self, layout: Layout, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified filter responses (cells, windows, FILTERS) of these cells, 0 past a text's end; and the symbols."""
        symbols = layout.window_symbols(cells)
        total = np.broadcast_to(self.bias, (*symbols.shape[:2], FILTERS)).copy()
        for place in range(WIDTH):
            total += self.tables[place].take(symbols[:, :, place], axis=0)
        np.maximum(total, 0, out=total)
        total *= layout.valid[cells][:, :, None]
        return total, symbols

    def cells(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Sum and maximum of each filter's responses in each cell."""
        sums = np.zeros((layout.n_cells, FILTERS), np.float32)
        maxima = np.zeros((layout.n_cells, FILTERS), np.float32)
        for low in range(0, layout.n_cells, SLAB):
            own = np.arange(low, min(low + SLAB, layout.n_cells))
            response = self.responses(layout, own)[0]
            sums[own], maxima[own] = response.sum(axis=1), response.max(axis=1)
        return sums, maxima

    def chunks(self, layout: Layout, sums: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """Mean response of each filter in each chunk, then the largest."""
        both = sums[layout.left] + np.where((layout.right > layout.left)[:, None], sums[layout.right], 0)
        top = np.maximum(maxima[layout.left], maxima[layout.right])
        return np.concatenate([both / layout.windows[:, None], top], axis=1)

    def pooled(self, layout: Layout, hidden: np.ndarray) -> np.ndarray:
        """The largest value of each hidden unit over the chunks of each text; 0 for an empty text."""
        n = len(layout.first_chunk) - 1
        out = np.zeros((n, HIDDEN), np.float32)
        filled = np.flatnonzero(np.diff(layout.first_chunk))
        if len(filled):
            out[filled] = np.maximum.reduceat(hidden, layout.first_chunk[filled], axis=0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each text."""
        layout = Layout(texts)
        # Plain sums, so that a text has the same score whatever texts stand beside it.
        chunks = self.chunks(layout, *self.cells(layout))
        hidden = np.maximum(np.einsum("cf,fh->ch", chunks, self.mix) + self.mix_bias, 0)
        margin = np.einsum("th,h->t", self.pooled(layout, hidden), self.out) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(margin.astype(float), -60, 60)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, rare: float = 1.0) -> tuple[float, list[np.ndarray]]:
        """Mean log loss and its gradient by each parameter; texts with label 0 count `rare` times."""
        layout = Layout(texts)
        sums, maxima = self.cells(layout)
        chunks = self.chunks(layout, sums, maxima)
        hidden = np.maximum(chunks @ self.mix + self.mix_bias, 0)
        pooled = self.pooled(layout, hidden)
        margin = (pooled @ self.out + self.out_bias).astype(float)
        p = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        weight = np.where(labels > 0, 1.0, rare)
        loss = -np.mean(weight * np.log(np.where(labels > 0, p, 1 - p) + 1e-12))
        d_margin = (weight * (p - labels) / len(texts)).astype(np.float32)
        grads = [np.zeros_like(x) for x in self.parameters()]
        grads[4], grads[5][0] = pooled.T @ d_margin, d_margin.sum()
        # The first chunk that has the largest value of a unit takes its gradient.
        d_hidden = np.zeros_like(hidden)
        for text in np.flatnonzero(np.diff(layout.first_chunk)).tolist():
            low, high = layout.first_chunk[text], layout.first_chunk[text + 1]
            top = low + hidden[low:high].argmax(axis=0)
            d_hidden[top, np.arange(HIDDEN)] += d_margin[text] * self.out * (pooled[text] > 0)
        grads[2], grads[3] = chunks.T @ d_hidden, d_hidden.sum(axis=0)
        d_chunks = d_hidden @ self.mix.T
        d_means, d_top = d_chunks[:, :FILTERS] / layout.windows[:, None], d_chunks[:, FILTERS:]
        d_sums, d_maxima = np.zeros_like(sums), np.zeros_like(maxima)
        wide = layout.right > layout.left
        in_left = maxima[layout.left] >= maxima[layout.right]
        np.add.at(d_sums, layout.left, d_means)
        np.add.at(d_sums, layout.right[wide], d_means[wide])
        np.add.at(d_maxima, layout.left, d_top * in_left)
        np.add.at(d_maxima, layout.right, d_top * ~in_left)
        used = np.flatnonzero(d_sums.any(axis=1) | d_maxima.any(axis=1))
        for low in range(0, len(used), SLAB):
            cells = used[low:low + SLAB]
            response, symbols = self.responses(layout, cells)
            d = np.repeat(d_sums[cells][:, None, :], response.shape[1], axis=1)
            at = response.argmax(axis=1)
            np.put_along_axis(d, at[:, None, :], np.take_along_axis(d, at[:, None, :], axis=1) + d_maxima[cells][:, None, :], axis=1)
            d = (d * (response > 0)).reshape(-1, FILTERS)
            grads[1] += d.sum(axis=0)
            for place in range(WIDTH):
                key = symbols[:, :, place].ravel()
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                grads[0][place][key[order][starts]] += np.add.reduceat(d[order], starts, axis=0)
        grads[0][:, PAD] = 0
        return float(loss), grads


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> Network:
    """Descent with running means of gradients and their squares, over batches in an order drawn anew each time.

    Label 0 counts as the root of the labels' ratio, which halves the odds' way to balance. Without both kinds of labels every score is the share of label 1 (0.5 without labels).
    """
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    network = Network.random(seed, share)
    if len(np.unique(labels)) < 2:
        network.out[:] = 0
        return network
    draw, rare = np.random.default_rng(seed), float(np.sqrt(share / (1 - share)))
    first = [np.zeros_like(x) for x in network.parameters()]
    second = [np.zeros_like(x) for x in network.parameters()]
    step, total = 0, epochs * (-(-len(texts) // batch))
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for low in range(0, len(order), batch):
            own = order[low:low + batch]
            _, grads = network.gradients([texts[i] for i in own], labels[own], rare)
            step += 1
            pace = rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for x, g, m, v in zip(network.parameters(), grads, first, second):
                own_pace = pace * (FILTER_PACE if x is network.tables else 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= (own_pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return network


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of rows that are not held out, in the order of a hash of doc_id.

    About `limit` documents, and of these those that fit into `limit_bytes` together.
    The driver gets their ids and lengths first, then only the texts that fit.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("quality").alias("_quality"))
    n = known.count()
    place = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30))
    known = known.where(place < int((1 << 30) * min(1.0, limit / max(1, n))))
    own = docs.select(row_id().alias("_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "_id")
    picked, room = [], limit_bytes
    sizes = own.select(place.alias("_place"), "_id", F.octet_length("text").alias("_bytes")).collect()
    for _, doc_id, size in sorted(map(tuple, sizes)):
        if size <= room:
            picked.append(doc_id)
            room -= size
    rows = own.where(F.col("_id").isin(picked)).select(place.alias("_place"), "_id", "text", "_quality").collect() if picked else []
    # A doc_id with several rows may have a text that did not fit: the bound holds for what is used.
    texts, values, room = [], [], limit_bytes
    for row in sorted(rows, key=lambda r: (r["_place"], r["_id"], r["text"])):
        data = row["text"].encode()
        if len(data) <= room:
            texts.append(data)
            values.append(min(1, max(0, row["_quality"])))
            room -= len(data)
    return texts, np.array(values, float)


def scored(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the whole text (null: empty) is an input."""
    fields = arrow_schema(docs.sparkSession, SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = columns_of(batch, "doc_id", "held_out", "text")
            data = [(t or "").encode() for t in texts]
            low = 0
            while low < len(data):
                high, room = low + 1, GROUP_BYTES - len(data[low])
                while high < len(data) and len(data[high]) <= room:
                    room -= len(data[high])
                    high += 1
                score = network.scores(data[low:high])
                yield pa.record_batch([
                    pa.array(ids[low:high], pa.int64()), pa.array(held[low:high], pa.bool_()),
                    pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32()),
                ], schema=fields)
                low = high

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(run, SCORED)


def classified(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`, learned from `labels.quality`.

    Null and empty texts get the score of a text without chunks. Equal texts get
    equal scores. Without documents there are no rows; without labels every score is 0.5.
    Labels of one doc_id that differ count as the largest. Rows sharing a doc_id are scored each by its text.
    """
    texts, values = training_sample(docs, labels, limit, limit_bytes)
    return scored(docs, train(texts, values))

"""Quality rules: boosted trees over document statistics.

Statistics of every whole text are computed in one pass. Trees are trained on a
bounded sample of labelled documents, with histograms of the statistics and
monotonic constraints, and are kept as flat arrays of nodes, over which a batch
of documents is scored level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shardlens.durable import store
from shardlens.llm.common import back_to_doc_id, map_rows, row_id, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Labelled documents that the trees are trained on, at most about so many.
TRAIN_DOCS = 20_000
# A document that passes the base rules goes only if its odds of being good are below this.
THRESHOLD = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_letters", "n_upper", "n_digits", "n_stops", "n_distinct_words", "longest_word"]
STATS = "_id bigint, " + ", ".join(f"{c} bigint" for c in [*BASE, *MORE])

# name: direction in which quality may move with it (0: any)
FEATURES = {
    "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "word_length": 0, "letter_rate": 0,
    "upper_rate": 0, "digit_rate": 0, "stop_rate": 0, "distinct_rate": 0, "longest_word": 0, "log_words": 0,
}

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".!?"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in runs of `window` words that the text has twice or more, each counted once."""
    if len(words) < window:
        return 0
    runs = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    covered = reach = 0
    for at, run in enumerate(runs):
        if counts[run] > 1:
            covered += at + window - max(reach, at)
            reach = at + window
    return covered


def statistics(text: str) -> tuple[int, ...]:
    """The values of BASE and MORE."""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    visible = b"".join(words)
    chars = len(visible.decode())
    upper = len(visible) - len(visible.translate(None, _UPPER))
    digits = len(visible) - len(visible.translate(None, _DIGITS))
    letters = chars - (len(visible) - len(visible.translate(None, _NOT_LETTERS)))
    return (
        len(words),
        chars,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text),
        len(lines),
        letters,
        upper,
        digits,
        len(data) - len(data.translate(None, _STOPS)),
        len(set(words)),
        max(map(len, words), default=0),
    )


_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def document_statistics(docs: DataFrame) -> DataFrame:
    """(_id, BASE, MORE) of every row; a null text has no words. Whole texts, nothing shuffled."""
    return map_rows(texts(docs), STATS, lambda: lambda key, text: [(key, *statistics(text))], "_id", "text")


def features(stats: pd.DataFrame) -> np.ndarray:
    """The statistics as FEATURES, one row a document."""
    words = np.maximum(stats["n_words"].to_numpy(float), 1)
    chars = np.maximum(stats["word_chars"].to_numpy(float), 1)
    lines = np.maximum(stats["n_lines"].to_numpy(float), 1)
    s = {c: stats[c].to_numpy(float) for c in [*BASE, *MORE]}
    return np.column_stack([
        s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["word_chars"] / words,
        s["n_letters"] / chars, s["n_upper"] / chars, s["n_digits"] / chars, s["n_stops"] / words,
        s["n_distinct_words"] / words, s["longest_word"], np.log1p(s["n_words"]),
    ])


@dataclass
class Trees:
    """All nodes of all trees in arrays; a leaf is its own child, so walks may go on."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(
    x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 40, depth: int = 4,
    rate: float = 0.2, bins: int = 64, smooth: float = 1.0, min_rows: int = 5,
) -> Trees:
    """Gradient boosting for yes/no labels.

    A split along a constrained feature is taken only if its sides' values stand
    in the right order, and bounds at their middle hold for all nodes below.
    Without both kinds of labels, the trees are empty and say the share of 1.
    """
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(monotone))]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if len(x) else None
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    margin = np.full(len(x), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + smooth), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        value = leaf(g.sum(), h.sum(), low, high)
        at = len(nodes)
        nodes.append([0, 0.0, at, at, value * rate])
        best = None
        if level < depth and len(rows) >= 2 * min_rows:
            for f, direction in enumerate(monotone):
                n_bins = len(edges[f]) + 1
                if n_bins < 2:
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, n_bins))[:-1] for w in (g, h, None))
                gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + smooth), low, high), np.clip(-gr / (hr + smooth), low, high)
                gain = -(gl * vl + 0.5 * (hl + smooth) * vl**2) - (gr * vr + 0.5 * (hr + smooth) * vr**2)
                gain += g.sum() * value + 0.5 * (h.sum() + smooth) * value**2
                gain[(nl < min_rows) | (nr < min_rows) | (direction * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, vl[k], vr[k])
        if best is None:
            margin[rows] += value * rate
            return at
        _, f, k, vl, vr = best
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
            monotone[f], ((low, high), (low, high))
        )
        side = binned[rows, f] <= k
        nodes[at][0], nodes[at][1] = f, edges[f][k]
        nodes[at][2] = grow(rows[side], level + 1, *bounds[0])
        nodes[at][3] = grow(rows[~side], level + 1, *bounds[1])
        return at

    if len(np.unique(y)) > 1:
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(
        flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64),
        flat[:, 4], np.array(roots, dtype=np.int64), depth, start,
    )


def training_sample(stats: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> pd.DataFrame:
    """Statistics and quality of labelled documents: all, or about `limit` chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").select(
        row_id().alias("_id"), F.col("quality").cast("int").alias("quality")
    )
    n = known.count()
    kept = known.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, limit / max(1, n))))
    return stats.join(kept.groupBy("_id").agg(F.max("quality").alias("quality")), "_id").toPandas().sort_values("_id")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of every row of `docs`.

    A null or empty text has no words and fails the base rules. Without labels
    all that pass the base rules are kept. Rows sharing a doc_id are judged each by its text.
    """
    stats = store(document_statistics(docs), "statistics")
    sample = training_sample(stats, labels, limit)
    trees = train(features(sample), sample["quality"].to_numpy(float), list(FEATURES.values()))
    schema = STATS + ", score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=trees.probability(features(batch)))

    scored = stats.mapInPandas(score, schema).withColumn("base_failed", base_failed())
    return scored.select(
        back_to_doc_id().alias("doc_id"), *BASE, "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )

"""Language of a text by unigram models that sum over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.
The likelihood of a word is the sum over all ways to cut it into pieces, found
by the forward algorithm; of a text, the product over its words. Piece
probabilities are learned by expectation maximisation over the same sums.

Distinct words are scored once per task, many at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from shardlens.llm.common import arrow_schema, columns_of, give_back_memory, map_rows, row_id, to_batch

UNDECIDED = "und"
# Training: at most about so many documents of each language, and so many languages.
DOCS_PER_LANGUAGE = 400
MAX_LANGUAGES = 256
ROUNDS = 3
MAX_PIECE = 8
# Longer words are cut; all of a word counts.
MAX_WORD = 40
UNKNOWN = 1e-7
SMOOTH = 0.1
# Bytes of remembered words, each about WORD_BYTES beside its scores.
KNOWN_BYTES, WORD_BYTES = 48 << 20, 160
TEXTS = 128
# A text's likelihood a character may be so many spreads below the mean, and so many more by its square root.
SLACK, CERTAIN = 2.75, 6.0
BLOCK_WORDS = 1 << 12
START = "▁"

PREDICTION = "doc_id bigint, held_out boolean, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Lower-case words with a mark at their start; long ones in several parts."""
    out = []
    for word in text.lower().split():
        if len(word) < MAX_WORD:
            out.append(START + word)
        else:
            word = START + word
            out += [word[i:i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def read_pieces(path: str, longest: int = MAX_PIECE) -> list[str]:
    """The lower-case pieces of a sentencepiece vocabulary up to a length, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in own]
    return sorted({p for p in pieces if len(p) <= longest and p == p.lower()})


class Pieces:
    """Finds the vocabulary's pieces in many words at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) < len(pieces):
            raise ValueError("two pieces share a hash")
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.lengths = sorted({len(p) for p in pieces})
        self.size = len(pieces)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """For words of one length: (end, length) -> piece of each word, `size` where there is none."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        found = {}
        for start in range(codes.shape[1]):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(codes.shape[1], start + self.lengths[-1]) + 1):
                h = h * self.FACTOR + codes[:, end - 1]
                at = np.searchsorted(self.hashes, h)
                at[at == self.size] = 0
                piece = np.where(self.hashes[at] == h, self.order[at], self.size)
                if end - start == 1 or (piece < self.size).any():
                    found[end, end - start] = piece
        return codes, found


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and words of equal length, in blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for i in range(0, len(places), BLOCK_WORDS):
            part = places[i:i + BLOCK_WORDS]
            yield part, [words[j] for j in part.tolist()]


@dataclass
class Model:
    """Probabilities (pieces + 1 for unknown, languages) of a vocabulary."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray
    prior: np.ndarray
    # Log likelihood a character of the training words in their own language, and its spread.
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.finder = Pieces(self.pieces)

    def forward(self, length: int, found: dict) -> list[np.ndarray]:
        n = len(next(iter(found.values())))
        alpha = [np.ones((n, len(self.languages)))]
        for end in range(1, length + 1):
            total = np.zeros_like(alpha[0])
            for size in range(1, min(end, MAX_PIECE) + 1):
                if (end, size) in found:
                    p = self.probabilities[found[end, size]]
                    if size > 1:
                        p = p * (found[end, size] < self.finder.size)[:, None]
                    total += alpha[end - size] * p
            alpha.append(total)
        return alpha

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for places, part in by_length(words):
            _, found = self.finder.find(part)
            out[places] = np.log(self.forward(len(part[0]), found)[-1])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece; `counts` is (words, languages)."""
        total = np.zeros((self.finder.size + 1, len(self.languages)))
        for places, part in by_length(words):
            length = len(part[0])
            _, found = self.finder.find(part)
            alpha = self.forward(length, found)
            beta = [np.zeros_like(alpha[0]) for _ in range(length)] + [np.ones_like(alpha[0])]
            weight = counts[places] / alpha[-1]
            for end in range(length, 0, -1):
                for size in range(1, min(end, MAX_PIECE) + 1):
                    if (end, size) not in found:
                        continue
                    piece = found[end, size]
                    p = self.probabilities[piece]
                    if size > 1:
                        p = p * (piece < self.finder.size)[:, None]
                    beta[end - size] += p * beta[end]
                    use = alpha[end - size] * p * beta[end] * weight
                    for k in range(use.shape[1]):
                        total[:, k] += np.bincount(piece, use[:, k], self.finder.size + 1)
        return total


def fit(words: dict[str, dict[str, int]], docs: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """A model from the word counts of each language."""
    languages = sorted(words)
    every = sorted({w for counts in words.values() for w in counts})
    place = {w: i for i, w in enumerate(every)}
    counts = np.zeros((len(every), len(languages)))
    for k, language in enumerate(languages):
        for word, n in words[language].items():
            counts[place[word], k] += n
    flat = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    flat[-1] = UNKNOWN
    prior = np.array([float(docs[k]) for k in languages])
    model = Model(languages, pieces, flat, prior / prior.sum())
    for _ in range(rounds if every else 0):
        uses = model.expected(every, counts)[:-1] + SMOOTH
        model.probabilities[:-1] = uses / uses.sum(axis=0)
    scores, lengths = model.score_words(every), np.fromiter(map(len, every), float, len(every))
    chars = np.maximum(1, lengths @ counts)
    model.mean = (counts * scores).sum(axis=0) / chars
    model.spread = np.sqrt((counts * (scores - lengths[:, None] * model.mean) ** 2).sum(axis=0) / chars)
    return model


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, vocabulary: str, per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Fit on a sample, by a hash of doc_id, of the rows that have a language and are not held out.

    The driver gets the sample's word counts; its size is bounded by
    `per_language` and MAX_LANGUAGES. None if there is no such row.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, per_language / r["count"]))])
    place = F.pmod(F.xxhash64(row_id(), F.lit(3)), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(place < share[F.col("lang")])

    def setup() -> Callable:
        return lambda lang, text: [(lang, w) for w in words_of(text)]

    counted = map_rows(sample, "lang string, word string", setup, "lang", "text").groupBy("lang", "word").count()
    words: dict[str, dict[str, int]] = {r["lang"]: {} for r in sizes}
    for row in counted.toLocalIterator():
        words[row["lang"]][row["word"]] = row["count"]
    return fit(words, {r["lang"]: r["count"] for r in sizes}, read_pieces(vocabulary))


class Scorer:
    """Scores texts; remembers words and their scores up to a bound in bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(model.languages)))

    def margins(self, batch: list[str]) -> np.ndarray:
        return self.likelihoods(batch)[0] + np.log(self.model.prior)

    def known(self, batch: list[str]) -> np.ndarray:
        """Whether each text's likelihood in its best language is not far below that language's usual one.

        The allowance a character shrinks as a text grows: a few odd words decide nothing.
        """
        likelihoods, chars = self.likelihoods(batch)
        best = (likelihoods + np.log(self.model.prior)).argmax(axis=1)
        allowed = self.model.spread[best] * (SLACK * chars + CERTAIN * np.sqrt(chars))
        return likelihoods[np.arange(len(batch)), best] >= self.model.mean[best] * chars - allowed

    def likelihoods(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and the characters of its words."""
        if len(self.words) * (WORD_BYTES + 8 * self.scores.shape[1]) > KNOWN_BYTES:
            self.words = {}
        known, words = self.words, [words_of(t) for t in batch]
        new = list({w for own in words for w in own if w not in known})
        if new:
            size = len(known) + len(new)
            if size > len(self.scores):
                wider = np.zeros((max(size, 2 * len(self.scores)), self.scores.shape[1]))
                wider[:len(known)] = self.scores[:len(known)]
                self.scores = wider
            self.scores[len(known):size] = self.model.score_words(new)
            known.update(zip(new, range(len(known), size)))
        out, chars = np.zeros((len(batch), len(self.model.languages))), np.zeros(len(batch))
        for i, own in enumerate(words):
            if own:
                chars[i] = sum(map(len, own))
                out[i] = self.scores[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(axis=0)
        return out, chars


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the prediction's probability) of every row.

    `und` with score 0 if the text is null or has no letter, or if nothing was
    learned. Only the text is an input. Nothing is shuffled.
    """
    fields = arrow_schema(docs.sparkSession, PREDICTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            ids, held, texts = columns_of(batch, "doc_id", "held_out", "text")
            for i in range(0, len(ids), TEXTS):
                part = [t if t and scorer and has_letter(t) else "" for t in texts[i:i + TEXTS]]
                rows = []
                margins = scorer.margins(part) if scorer else None
                for j, text in enumerate(part):
                    lang, score = UNDECIDED, 0.0
                    if text:
                        best = int(np.argmax(margins[j]))
                        lang = model.languages[best]
                        score = float(1 / np.exp(margins[j] - margins[j, best]).sum())
                    rows.append((ids[i + j], held[i + j], lang, score))
                yield to_batch(rows, fields)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(run, PREDICTION)


def known_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """Those rows of `docs` that have a letter and read like one of the learned languages; all columns stay.

    A text goes if its likelihood a character lies far below what is usual in the language
    that suits it best, with more room the shorter it is. A short text may be of any of several
    languages and still be sound, so no text goes for being undecided between them.
    Nulls and empty texts go, and all texts if nothing was learned.
    """

    @F.pandas_udf("boolean")
    def decided(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model) if model else None
        for texts in batches:
            keep = np.zeros(len(texts), bool)
            for i in range(0, len(texts) if scorer else 0, TEXTS):
                part = [t if t and has_letter(t) else "" for t in texts.iloc[i:i + TEXTS]]
                keep[i:i + TEXTS] = scorer.known(part) & np.array([bool(t) for t in part])
            yield pd.Series(keep)
        scorer = texts = part = None
        give_back_memory()

    return docs.where(decided(F.col("text")))

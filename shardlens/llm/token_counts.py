"""Token counts by greedy longest match, without building the tokens.

Words are cut into the longest vocabulary piece that begins them, then the
longest continuation piece, and so on. A trie of the pieces is walked once,
character by character. Where it cannot go on, a failure link leads to the node
of what is left after the pieces that greedy matching would take, and a count says how
many those are; both are computed for every node beforehand.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import sentencepiece
from pyspark.sql import DataFrame

from shardlens.llm.common import back_to_doc_id, map_rows, texts

START = "▁"
KNOWN_WORDS = 1 << 19
NONE = -1

COUNTS = "_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


def read_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces that begin words and pieces that continue them, of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in own]
    first = {p[1:] for p in pieces if p.startswith(START) and len(p) > 1 and START not in p[1:]}
    return first, {p for p in pieces if START not in p}


class Automaton:
    """Trie with failure links. Node 0 begins words, node 1 continues them."""

    def __init__(self, first: set[str], rest: set[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.final = [False, False]
        depth_order: list[tuple[int, int, str]] = []
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    below = self.children[at].get(c)
                    if below is None:
                        below = len(self.children)
                        self.children[at][c] = below
                        self.children.append({})
                        self.final.append(False)
                        depth_order.append((at, below, c))
                    at = below
                self.final[at] = True
        self.fail = [NONE] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for c, below in self.children[at].items():
                if self.final[below]:
                    # All of it is one piece; what follows continues the word.
                    self.fail[below], self.popped[below] = 1, 1
                else:
                    # Take the pieces of the parent's failures until the character fits.
                    node, count = self.fail[at], self.popped[at]
                    while node != NONE and c not in self.children[node]:
                        count += self.popped[node]
                        node = self.fail[node]
                    if node != NONE:
                        self.fail[below], self.popped[below] = self.children[node][c], count
                queue.append(below)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut into pieces."""
        children, fail, popped = self.children, self.fail, self.popped
        at, count = 0, 0
        for c in word:
            while (below := children[at].get(c)) is None:
                if fail[at] == NONE:
                    return 0
                count += popped[at]
                at = fail[at]
            at = below
        while at > 1:
            if fail[at] == NONE:
                return 0
            count += popped[at]
            at = fail[at]
        return count


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row of `docs`.

    Words stand between ASCII blanks. A word that cannot be cut into pieces is
    one unknown token. A null or empty text has none. Nothing is shuffled.
    """

    def setup() -> Callable:
        automaton = Automaton(*read_vocabulary(vocabulary))
        known: dict[bytes, int] = {}

        def count(key: int, text: str) -> list[tuple]:
            words = text.encode().split()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = automaton.count(word.decode())
            counts = list(map(known.__getitem__, words))
            unknown = counts.count(0)
            return [(key, len(words), sum(counts) + unknown, unknown)]

        return count

    found = map_rows(texts(docs), COUNTS, setup, "_id", "text")
    return found.select(back_to_doc_id().alias("doc_id"), "n_words", "n_tokens", "n_unknown")

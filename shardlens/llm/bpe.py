"""Byte-level BPE encoding and decoding with the tiktoken library.

A text is encoded match by match of the split pattern. Long texts are cut first,
at places where a match must begin whatever stands around them, so the library
never holds one huge input, and ids are the same as for the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import regex
import tiktoken
from pyspark.sql import DataFrame

from shardlens.llm.common import back_to_doc_id, map_rows, texts

# A longer text is cut into parts of about this many code points.
PART_CHARS = 1 << 16
# A longer run of white space is given to the merges directly.
LONG_BLANK = 1 << 12

DIGESTS = "_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one rank file, without special tokens."""

    def __init__(self, ranks_path: str, pattern: str, part_chars: int = PART_CHARS, long_blank: int = LONG_BLANK):
        ranks = read_ranks(ranks_path)
        self.matches = tiktoken.Encoding("matches", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.part_chars = part_chars
        # A blank after a visible character always begins a match.
        self.safe = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \t\r\n])")
        self.blank = regex.compile(r"\p{White_Space}{%d,}" % long_blank)

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that can be encoded one by one."""
        start = 0
        while len(text) - start > self.part_chars:
            cut = self.safe.search(text, start + self.part_chars)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def _encode_part(self, part: str) -> list[int]:
        if len(part) < self.part_chars // 2:
            return self.matches.encode_ordinary(part)
        # The pattern would step back through a long blank run character by
        # character; its match is known: all of it at the end, else all but the last.
        ids: list[int] = []
        start = 0
        for run in self.blank.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            ids += self.matches.encode_ordinary(part[start:run.start()])
            ids += self.whole.encode_ordinary(part[run.start():end])
            start = end
        return ids + self.matches.encode_ordinary(part[start:])

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, part by part."""
        return map(self._encode_part, self.parts(text))

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids; they need not be whole characters."""
        return self.matches.decode_bytes(ids)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(_id, ids array<int>) of every row of `docs`; a null text has no ids."""

    def setup() -> Callable:
        codec = Codec(ranks_path, pattern)
        return lambda key, text: [(key, [i for part in codec.encode(text) for i in part])]

    return map_rows(texts(docs), "_id bigint, ids array<int>", setup, "_id", "text")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(_id, bytes binary) of rows with `_id` and `ids`; null ids give no bytes."""

    def setup() -> Callable:
        codec = Codec(ranks_path, pattern)
        return lambda key, ids: [(key, codec.decode(ids or []))]

    return map_rows(encoded, "_id bigint, bytes binary", setup, "_id", "ids")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass and keep counts and digests only.

    One row per row of `docs`; nothing is shuffled, and ids of a long text are
    hashed part by part, so memory is bounded by one text and one part's ids.
    """

    def setup() -> Callable:
        codec = Codec(ranks_path, pattern)
        decimal = [str(i) for i in range(codec.matches.n_vocab)]

        def digest(key: int, text: str) -> list[tuple]:
            ids_hash, bytes_hash, count = hashlib.sha256(), hashlib.sha256(), 0
            for ids in codec.encode(text):
                if ids:
                    comma = "," if count else ""
                    ids_hash.update((comma + ",".join(map(decimal.__getitem__, ids))).encode())
                    bytes_hash.update(codec.decode(ids))
                    count += len(ids)
            return [(key, count, ids_hash.hexdigest(), bytes_hash.hexdigest())]

        return digest

    return map_rows(texts(docs), DIGESTS, setup, "_id", "text")

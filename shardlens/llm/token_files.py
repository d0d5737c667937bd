"""Token ids as binary files that can be read in part.

A file holds the ids of a range of documents, in ascending doc_id order, as
little-endian unsigned 32-bit integers. They are cut into groups of whole
documents, and each group is an independent zstandard frame with a checksum of
its content. Two skippable frames follow: the index (doc_id, frame, number of
ids of each document) and the seek table of the zstandard seekable format
(compressed size, size and checksum of each frame). A reader takes the last bytes first and
then only the frames that hold what it was asked for.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from shardlens.durable import durable_folder, store
from shardlens.llm.common import arrow_schema, back_to_doc_id, columns_of, kept_in_worker, map_rows, shuffle_width, texts, to_batch

# Fixed values of the zstandard seekable format.
SKIPPABLE = 0x184D2A5E
INDEX_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

END_ID = 2
FRAME_BYTES = 1 << 18
# Words of the memory in use; the one before it is kept beside it.
CACHED_WORDS = 1 << 18
# Bytes of text, about, whose words are looked up together; words of letters that go to the tokenizer in one text.
CHUNK_BYTES = 2 << 20
WORDS_A_TEXT = 256
# Letters that stay one letter when lowered, İ left out, before ASCII symbols.
LETTERS_AND_SYMBOLS = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]+)")
LEVEL = 3
# Fixed value: how the vocabulary marks the last piece of a word.
WORD_END = "</w>"

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"
DOCUMENT = "_id bigint, row int, n_tokens bigint, ids binary"


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case and never joins what ASCII blanks part.

    Texts are encoded many at a time: Arrow parts them at blanks, A-Z lowered, and each different word is
    looked up once. Words are remembered, up to a bound; those seen last stay longest. A
    word of Latin letters before ASCII symbols is two pieces to the tokenizer, and to the memory.
    """

    def __init__(self, path: str, end_id: int = END_ID, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        # The library finds its special strings as they stand and encodes what lies between on its own.
        special = {t.content: struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = special
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Words are lower case; what is a special string only then is plain text.
        self.tokenizer.encode_special_tokens = True
        self.end = struct.pack("<I", end_id)
        # Which ids are the last of a word.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached_words = cached_words

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        found = self._plain(texts)
        for row in self._with_special(texts):
            parts = self.between.split(texts[row].as_py())
            own = self._plain(pa.array(parts, texts.type))
            found[row] = b"".join(self.special.get(p, ids) for p, ids in zip(parts, own))
        return [ids + self.end for ids in found]

    def _with_special(self, texts: pa.Array) -> list[int]:
        rows: set[int] = set()
        for content in self.special:
            rows.update(np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist())
        return sorted(rows)

    def _plain(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        each = words.flatten().dictionary_encode()
        known = pa.array(self._looked_up(each.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        # The ids of all words one after the other, and where each text's end.
        ids = known.take(each.indices)
        if not len(ids):
            return [b""] * len(texts)
        offsets, data = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        stops = offsets[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [data[start:stop].tobytes() for start, stop in zip(stops, stops[1:])]

    def _looked_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        self._learn(self._unknown(missing))
        ids_of_missing = map(self.known.__getitem__, missing)
        found = [next(ids_of_missing) if ids is None else ids for ids in found]
        if len(self.known) > self.cached_words:
            self.known, self.older = {}, self.known
        return found

    def _unknown(self, words: list[str]) -> list[str]:
        """Those that are not in the older memory either; what it holds is taken over."""
        ids = list(map(self.older.get, words))
        self.known.update((w, own) for w, own in zip(words, ids) if own is not None)
        return [w for w, own in zip(words, ids) if own is None]

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone go to the tokenizer many in one text, whose ids are parted at ends of words."""
        halves = {w: found.groups() for w in words if not w.isalpha() and (found := LETTERS_AND_SYMBOLS.fullmatch(w))}
        pieces = dict.fromkeys(w for w in words if w not in halves)
        both = {half for pair in halves.values() for half in pair}
        pieces.update(dict.fromkeys(self._unknown([half for half in both if half not in self.known])))
        letters = [w for w in pieces if w.isalpha()]
        for low in range(0, len(letters), WORDS_A_TEXT):
            group = letters[low:low + WORDS_A_TEXT]
            ids = self._ids([" ".join(group)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                data, start = ids.tobytes(), 0
                for word, end in zip(group, (4 * ends).tolist()):
                    self.known[word] = data[start:end]
                    start = end
        alone = [w for w in pieces if w not in self.known]
        for word, own in zip(alone, self._ids(alone)):
            self.known[word] = own.tobytes()
        for word, (stem, symbols) in halves.items():
            self.known[word] = self.known[stem] + self.known[symbols]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]


class FrameWriter:
    """Writes documents to one file object."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out = out
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.group: list[bytes] = []
        self.held = self.n_docs = self.n_tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.index.append((doc_id, len(self.frames), len(ids) // 4))
        self.group.append(ids)
        self.held += len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.held >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        data = b"".join(self.group)
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.group, self.held = [], 0

    def close(self) -> None:
        if self.group:
            self._close_frame()
        index = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(self.index, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = np.array(self.frames, dtype="<u4").tobytes()
        foot = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        # Where the index begins, for readers of documents; in a skippable frame of its own
        # it would be lost to seekable readers, so it stands right before the seek table.


class FrameReader:
    """Reads asked documents of one file object that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - 12 * frames
        if struct.unpack("<II", self._at(table - 8, 8)) != (SKIPPABLE, 12 * frames + 9):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(self._at(table, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_FRAME or at + 8 + length != table - 8:
            raise ValueError("broken index")
        packed = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        self.index = np.frombuffer(packed, dtype="<i8").reshape(-1, 3)

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[number]), int(packed)), max_output_size=int(size))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, row in the file, ids); with `wanted`, only frames that hold such ids are unpacked."""
        taken, data, at = -1, b"", 0
        for row, (doc_id, number, count) in enumerate(self.index.tolist()):
            if number != taken:
                taken, data, at = number, None, 0
            if wanted is None or doc_id in wanted:
                data = self.frame(number) if data is None else data
                yield doc_id, row, data[at:at + 4 * count]
            at += 4 * count


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or an address of one, as tasks see it."""
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def chunks_of(batch: pa.RecordBatch, name: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `size` bytes of texts each, and one row at least."""
    held = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def write_documents(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode `docs`, write one file a range of doc_id to `folder`, return the manifest.

    A task writes under a name of its own and renames at the end, so repeated
    and speculative attempts leave one whole file. A null text has the end id
    only; rows of equal doc_id stand by text; a null doc_id comes last.
    """
    spark = docs.sparkSession
    fields = arrow_schema(spark, MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("words", tokenizer_path, end_id), lambda: WordEncoder(tokenizer_path, end_id))
        files, root = open_folder(folder)
        part = TaskContext.get().partitionId()
        final, draft = f"{root}/part-{part:06d}.ids", f"{root}/.draft-{part:06d}-{uuid.uuid4().hex}"
        out = writer = None
        for batch in batches:
            for rows in chunks_of(batch, "text"):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(draft)
                    writer = FrameWriter(out)
                for doc_id, ids in zip(*columns_of(rows, "_id"), encoder.encode_all(rows.column("text"))):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            files.move(draft, final)
            yield to_batch([(part, final, writer.n_docs, writer.n_tokens)], fields)

    # A few partitions in each core's turn, and none that must hold much: ids go to the file at once.
    ordered = texts(docs).repartitionByRange(shuffle_width(spark), "_id").sortWithinPartitions("_id", "text")
    return store(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """(part, _id, row, n_tokens, ids) of the documents in the files of a manifest, or of `wanted` ones."""
    fields = arrow_schema(manifest.sparkSession, "part int, " + DOCUMENT)

    def setup() -> Callable:
        files, _ = open_folder(folder)

        def read(part: int, path: str) -> Iterator[tuple]:
            with files.open_input_file(path) as source:
                for doc_id, row, ids in FrameReader(source).documents(wanted):
                    yield part, doc_id, row, len(ids) // 4, ids

        return read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = setup()
        for batch in batches:
            for values in zip(*columns_of(batch, "part", "path")):
                rows, held = [], 0
                for out in read(*values):
                    rows.append(out)
                    held += len(out[-1])
                    if held > 1 << 24:
                        yield to_batch(rows, fields)
                        rows, held = [], 0
                yield to_batch(rows, fields)

    # Files are spread over tasks by number, one or two each.
    spread = manifest.select("part", "path").repartition(shuffle_width(manifest.sparkSession), "part")
    return spread.mapInArrow(run, "part int, " + DOCUMENT)


def part_starts(manifest: DataFrame) -> DataFrame:
    """(part, n_docs, _first): ids before each file. The manifest has one row a file."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_first"))


def token_digests(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files and give doc_id, start, n_tokens and ids_crc32 of each document as read back.

    One file's documents are read in order by one task, which counts on from the
    start of its file. An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or f"{durable_folder(spark)}/token_files/{uuid.uuid4().hex}"
    manifest = write_documents(docs, tokenizer_path, folder, end_id)
    starts = store(manifest.join(part_starts(manifest), "part").select("part", "path", "_first"), "starts")
    schema = "_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def setup() -> Callable:
        files, _ = open_folder(folder)

        def read(path: str, first: int) -> Iterator[tuple]:
            with files.open_input_file(path) as source:
                for doc_id, _, ids in FrameReader(source).documents():
                    yield doc_id, first, len(ids) // 4, zlib.crc32(ids)
                    first += len(ids) // 4

        return read

    spread = starts.repartition(shuffle_width(spark), "path")
    read_back = map_rows(spread, schema, setup, "path", "_first")
    return read_back.select(back_to_doc_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")

"""A folder tree of objects as a stream: what came since the last batch.

Shards are named by hashes, so new ones sort anywhere among the old, and a last key would miss those
before it. A batch therefore takes the objects that were changed in its span of time, whatever their names:
its offset is the end of that span, and the checkpoint keeps it over restarts.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyarrow import fs as arrow_fs

from shardlens.sources.listing import open_store

FORMAT = "live_listing"
# Seconds that an object must be old before it is taken: more than clocks differ and times are rounded.
SETTLE = 5.0
# Name, size, time of change in nanoseconds, and whether it is a folder, of all entries of a folder.
Entries = Callable[[str], "Iterator[tuple[str, int, int, bool]]"]


def entries_of(files: arrow_fs.FileSystem) -> Entries:
    """Lists a folder one entry after the other (local), or as its file system hands it over."""

    def local(folder: str) -> Iterator[tuple[str, int, int, bool]]:
        if not os.path.isdir(folder):
            return
        with os.scandir(folder) as found:
            for e in found:
                about = e.stat()
                yield e.name, about.st_size, about.st_mtime_ns, e.is_dir()

    def remote(folder: str) -> Iterator[tuple[str, int, int, bool]]:
        for e in files.get_file_info(arrow_fs.FileSelector(folder, recursive=False, allow_not_found=True)):
            yield e.base_name, e.size or 0, e.mtime_ns or 0, e.type == arrow_fs.FileType.Directory

    return local if isinstance(files, arrow_fs.LocalFileSystem) else remote


def walk(entries: Entries, top: str, prefix: str) -> Iterator[tuple[str, int, int]]:
    """(key, size, time of change) of every object below `top` whose key begins with `prefix`.

    Subfolders wait as names; objects are handed on one by one.
    """
    folder, begin = prefix.rpartition("/")[0], prefix.rpartition("/")[2]
    waiting = [(folder, begin)]
    while waiting:
        folder, begin = waiting.pop()
        for name, size, changed, is_folder in entries(f"{top}/{folder}" if folder else top):
            if not name.startswith(begin):
                continue
            key = f"{folder}/{name}" if folder else name
            if is_folder:
                waiting.append((key, ""))
            else:
                yield key, size, changed


class _Part(InputPartition):
    def __init__(self, prefix: str, after: int, upto: int):
        self.prefix, self.after, self.upto = prefix, after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, prefixes: list[str], settle: float):
        self.root, self.prefixes, self.settle = root, prefixes, settle

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(prefix, start["upto"], end["upto"]) for prefix in self.prefixes]

    def read(self, partition: _Part) -> Iterator[tuple[str, int]]:
        files, top = open_store(self.root)
        for key, size, changed in walk(entries_of(files), top, partition.prefix):
            if partition.after < changed <= partition.upto:
                yield key, size


class LiveListing(DataSource):
    """`spark.readStream.format("live_listing")`: (key, size) of objects below `path`.

    Options: `path`; `prefixes`, a JSON list of beginnings of keys that do not overlap (a task each; a
    large folder may be cut by the first characters of its names), else all keys in one task; `settle`, seconds.
    An object arrives once, and again if it is changed. Objects that are moved in with an
    old time of change are not seen: list those with `scan_listing`.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, size bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        prefixes = json.loads(self.options.get("prefixes", '[""]'))
        one = next(((a, b) for i, a in enumerate(prefixes) for b in prefixes[i + 1:] if a.startswith(b) or b.startswith(a)), None)
        if one:
            raise ValueError(f"prefixes overlap, and objects would arrive twice: {one[0]!r} and {one[1]!r}")
        return _Reader(self.options["path"], prefixes, float(self.options.get("settle", SETTLE)))


def read_live(spark: SparkSession, root: str, prefixes: list[str] | None = None, settle: float = SETTLE):
    """A stream of the (key, size) of new and changed objects below `root`."""
    spark.dataSource.register(LiveListing)
    return (
        spark.readStream.format(FORMAT).option("path", root).option("settle", str(settle))
        .option("prefixes", json.dumps(prefixes or [""])).load()
    )

"""Listings of an object store as (key, size).

Folders are listed in pages by start-after. What is left of a folder after a full page is
cut into ranges of names, which are listed by other tasks in the next round.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardlens.durable import store
from shardlens.schemas import LISTING

# Entries of a page; a task holds no more of a folder.
PAGE = 1000
# Ranges that the rest of a folder is cut into at a time, at most.
MOST_CUTS = 64
# One entry of a folder: its name, size, and whether it is a folder.
Entry = tuple[str, int, bool]
# Lists a folder: path, names after this, names up to this (None: all), at most so many.
# Returns the smallest names of that range in order. `list_page` is one.
Lister = Callable[[str, str, "str | None", int], "list[Entry]"]

# Objects have a size; folders and ranges still to be listed have none.
_ROW = "folder string, after string, upto string, size bigint, kind string"
OBJECT, RANGE = "object", "range"


def open_store(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of an address and the path in it."""
    if "://" not in root or root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), re.sub("^file:/*", "/", root).rstrip("/")
    files, path = arrow_fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    return files, path.rstrip("/")


def list_page(files: arrow_fs.FileSystem) -> Lister:
    """Pages of a folder by its file system.

    A local folder is read entry by entry, of which only a page is kept. Arrow's other file systems
    hand over a folder at once: give `scan_listing` the store's own client there if folders are large.
    """
    local = isinstance(files, arrow_fs.LocalFileSystem)

    def entries(folder: str, after: str, upto: str | None) -> Iterator:
        if local:
            with os.scandir(folder) as found:
                yield from ((e.name, e) for e in found if e.name > after and (upto is None or e.name <= upto))
        else:
            for e in files.get_file_info(arrow_fs.FileSelector(folder, recursive=False)):
                if e.base_name > after and (upto is None or e.base_name <= upto):
                    yield e.base_name, e

    def page(folder: str, after: str, upto: str | None, limit: int) -> list[Entry]:
        first = heapq.nsmallest(limit, entries(folder, after, upto), key=lambda e: e[0])
        if local:
            return [(name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()) for name, e in first]
        return [(name, e.size or 0, e.type == arrow_fs.FileType.Directory) for name, e in first]

    return page


def cut_range(names: list[str], upto: str | None) -> list[tuple[str, str | None]]:
    """(after, upto) of the parts of what follows a page of `names` in its range.

    Names are cut after what all names of the page begin with, at each character that the
    page has anywhere: keys that end in hashes fall into even parts. The parts
    are all of (last name, upto], so an odd cut costs an empty page and loses nothing.
    """
    last = names[-1]
    begin = os.path.commonprefix([names[0], last])
    cuts = [begin + c for c in sorted(set("".join(names)))]
    cuts = [c for c in cuts if c > last and (upto is None or c < upto)]
    cuts = cuts[::-(-len(cuts) // MOST_CUTS) or 1]
    return list(zip([last, *cuts], [*cuts, upto]))


def _pages(lister: Lister, page: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One page of each given range: its objects, its folders as whole ranges, and the ranges left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, after, upto in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = lister(folder, after, upto, page)
                rows = [
                    (f"{folder}/{name}", "", None, None, RANGE) if is_folder else (f"{folder}/{name}", "", None, size, OBJECT)
                    for name, size, is_folder in found
                ]
                if len(found) >= page:
                    rows += [(folder, low, high, None, RANGE) for low, high in cut_range([n for n, _, _ in found], upto)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["folder", "after", "upto", "size", "kind"]
                )

    return run


def scan_listing(spark: SparkSession, root: str, lister: Lister | None = None, page: int = PAGE) -> DataFrame:
    """All objects below `root`, empty ones and names with a leading `_` or `.` too.

    Spark's own file sources hide such names, so folders are listed by tasks, in rounds.
    A round takes one page of each folder and range that is known; subfolders and the
    ranges that a full page leaves are the next round's. So a flat folder of any
    number of objects is listed by many tasks, none of which holds more than a page. Only paths
    and lengths are read. `lister` travels to the workers; without one, `root` is opened by
    Arrow. Use `read_inventory` where the store writes inventories.
    """
    if lister is None:
        files, top = open_store(root)
        lister = list_page(files)
    else:
        top = root.rstrip("/")
    ranges = spark.createDataFrame([(top, "", None)], "folder string, after string, upto string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    while True:
        # Ranges of one folder go to different tasks; a given number of these is not coalesced, small as the ranges are.
        dealt = ranges.repartition(tasks, "folder", "after")
        listed = store(dealt.mapInArrow(_pages(lister, page), _ROW), "listing")
        found = listed if found is None else found.unionByName(listed)
        ranges = listed.where(F.col("kind") == RANGE).select("folder", "after", "upto")
        if ranges.isEmpty():
            break
    key = F.substring(F.col("folder"), F.lit(len(top) + 2), F.length("folder"))
    return found.where(F.col("kind") == OBJECT).select(key.alias("key"), "size")


def read_inventory(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A (key, size) inventory table, as object stores export them."""
    return spark.read.schema(LISTING).format(format).load(path)

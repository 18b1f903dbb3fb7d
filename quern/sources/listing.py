"""A Python data source that lists folders: one partition for each root, split further where a root is too large.

``spark.dataSource.register(FolderListing)`` and ``spark.read.format("folder_listing").option("roots", "a,b")``. Options:
``depth`` (levels below a root), ``split`` (a root becomes itself at depth 1 and each child, by name), ``exclude`` (names
to leave out), ``timeout_s`` (a folder tree that takes longer is listed again in parts: its own files, then each child, down
to ``fixed.SPLIT_DEPTH`` levels, where only the files directly there are listed), ``large`` (folders that a listing before had
many files below, as :func:`large_folders` gives them: each becomes a partition of its own files and one for each child, so what
was slow is dealt to several tasks from the start). A root that can't be read gives no rows if
``skip_errors`` is true, else an error. The folders must be visible to all executors; on one machine any folder is.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions import fixed
from quern.functions import text as X

SCHEMA = "file_id string, path string, name string, size long, mod_time string, root string"


@dataclass
class RootPartition(InputPartition):
    root: str
    start: str
    depth: int


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", "").split(",") if r]
        self.depth = int(options.get("depth", "64"))
        self.split = options.get("split", "false").lower() == "true"
        self.exclude = {x for x in options.get("exclude", "").split(",") if x}
        self.skip_errors = options.get("skip_errors", "false").lower() == "true"
        self.timeout = float(options.get("timeout_s", "inf"))
        self.large = set(json.loads(options.get("large", "[]")))

    def partitions(self):
        out = []
        for root in self.roots:
            children: list[str] = []
            if self.split:
                try:
                    children = sorted(e.name for e in os.scandir(root) if e.is_dir() and e.name not in self.exclude)
                except OSError:
                    children = []
            if children:
                out += [RootPartition(root, root, 1), *[p for c in children for p in self._planned(root, os.path.join(root, c), self.depth - 1)]]
            else:
                out += self._planned(root, root, self.depth)
        return out

    def _planned(self, root: str, start: str, depth: int) -> list[RootPartition]:
        """A partition for a tree, or, where it was large before, for its own files and for each of its parts."""
        children: list[str] = []
        if start in self.large and depth > 1:
            try:
                children = sorted(e.path for e in os.scandir(start) if e.is_dir() and e.name not in self.exclude)
            except OSError:  # the partition's own reading tells of it
                children = []
        if not children:
            return [RootPartition(root, start, depth)]
        return [RootPartition(root, start, 1), *[p for c in children for p in self._planned(root, c, depth - 1)]]

    def read(self, partition: RootPartition) -> Iterator[tuple]:
        yield from self._resolve(partition.root, partition.start, partition.depth, 0)

    def _resolve(self, root: str, start: str, depth: int, level: int) -> Iterator[tuple]:
        """Rows of a tree; if it takes too long, of its parts. Rows of a tree wait until it is done, so none comes twice."""
        try:
            rows = self._walk(root, start, depth, time.monotonic() + self.timeout)
        except TimeoutError:
            rows = self._walk(root, start, 1, float("inf"))
            yield from rows
            if level < fixed.SPLIT_DEPTH and depth > 1:
                for e in sorted(os.scandir(start), key=lambda e: e.name):
                    if e.is_dir() and e.name not in self.exclude:
                        yield from self._resolve(root, e.path, depth - 1, level + 1)
            return
        yield from rows

    def _walk(self, root: str, start: str, depth: int, deadline: float) -> list[tuple]:
        out, stack = [], [(start, depth)]
        while stack:
            at, left = stack.pop()
            if time.monotonic() > deadline:
                raise TimeoutError(at)
            try:
                entries = sorted(os.scandir(at), key=lambda e: e.name)
            except OSError:
                if self.skip_errors:
                    continue
                raise
            for e in entries:
                if e.name in self.exclude:
                    continue
                if e.is_dir():
                    if left > 1:
                        stack.append((e.path, left - 1))
                    continue
                info, path = e.stat(), os.path.relpath(e.path, root)
                stamp = datetime.fromtimestamp(info.st_mtime, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                out.append((f"{root}:{path}", path, e.name, info.st_size, stamp, root))
        return out


def large_folders(listing: DataFrame, most: int, levels: int = fixed.SPLIT_DEPTH) -> str:
    """The folders of a listing (``root, path``), down to ``levels`` below their root, with more than ``most`` files below them, as
    the option ``large``. There are ``levels + 1`` times as many as the listing has files by ``most``, at most; only these come to
    the driver."""
    parts = F.split("path", "/")
    depth = F.least(F.size(parts) - 1, F.lit(levels))
    above = F.transform(F.sequence(F.lit(0), depth), lambda k: F.concat_ws("/", F.col("root"), F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    n = listing.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return json.dumps(sorted(r[0] for r in n.where(F.col("n") > most).select("folder").collect()))


def default_roots(own: str, shared: str, drives: Callable[[], list[str]]) -> list[str]:
    """One's own folder, what is shared with one, and the shared drives; without the last if they can't be listed."""
    try:
        return [own, shared, *drives()]
    except OSError:
        return [own, shared]


def cache_path(folder: str, file_id: str, name: str) -> str:
    """Where a file of that id is kept: below the first two characters of the id, by a name that any file system can have."""
    return os.path.join(folder, file_id[:2], "+".join(file_id.split()), X.safe_name(name))


def cached(folder: str, file_id: str, name: str, fetch: Callable[[str], bytes | None]) -> str | None:
    """The path of a file's copy, fetched unless it is there. A field of several ids is a shortcut: each is tried, and if none
    has anything behind it the file is skipped (None). A copy appears whole or not at all."""
    at = cache_path(folder, file_id, name)
    if os.path.exists(at):
        return at
    for one in file_id.split() or [file_id]:
        data = fetch(one)
        if data is not None:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = os.path.join(os.path.dirname(at), f"{os.getpid()}.part")
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, at)
            return at
    return None


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

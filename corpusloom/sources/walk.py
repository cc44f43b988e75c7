"""Files below a root as a Spark data source that lists in its tasks.

A partition is a run of sibling directories with all below them, or one directory's own
files. Planning lists from the root down, widest first, only until there are enough
partitions; tasks list the rest, and never what lies below a skipped name. Within a
directory files come before directories, and directories in falling order, as a walk with
a stack meets them; partitions follow each other likewise, so ``place`` numbers files in
that order without a shuffle. Links aren't followed. What can't be listed, and what is gone
by the time it is read, is left out; a file that can't be read has a null content.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Partitions to aim at; bytes of contents in a batch; files that one partition numbers.
WIDE, BATCH_BYTES, PLACES = 256, 8 << 20, 1 << 33
_SCHEMA = "path string, size long, mtime_ms double, place long"


@dataclass
class Run(InputPartition):
    """``tops``: directories with all below them; or ``own``: a directory whose files alone count."""

    nth: int
    tops: tuple[str, ...] = ()
    own: str | None = None


def listed(folder: str, file_names: frozenset[str], skipped: frozenset[str]) -> tuple[list[str], list[str]]:
    """The fitting files of a directory, rising, and its directories, falling."""
    files, folders = [], []
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in skipped:
                        folders.append(entry.name)
                elif entry.name in file_names and entry.is_file(follow_symlinks=False):
                    files.append(entry.name)
    except OSError:
        return [], []
    key = os.fsencode
    return [os.path.join(folder, n) for n in sorted(files, key=key)], [os.path.join(folder, n) for n in sorted(folders, key=key, reverse=True)]


def planned(root: str, file_names: frozenset[str], skipped: frozenset[str], wide: int = WIDE) -> list[Run]:
    """Partitions in the order of the walk. A directory with many below it is cut in runs,
    so there are about ``wide`` however the tree is shaped: what is listed here is at most
    ``wide`` directories."""
    opened, width = 0, 1
    waiting = deque([root])
    spread: dict[str, tuple[bool, list[str]]] = {}
    while waiting and width < wide and opened < wide:
        folder = waiting.popleft()
        files, below = listed(folder, file_names, skipped)
        spread[folder] = bool(files), below
        opened, width = opened + 1, width - 1 + len(below) + bool(files)
        waiting.extend(below)
    order: list[tuple[str, tuple[str, ...]]] = []
    stack = [root]
    while stack:
        folder = stack.pop()
        if folder not in spread:
            order.append(("tops", (folder,)))
            continue
        own, below = spread[folder]
        if own:
            order.append(("own", (folder,)))
        stack.extend(reversed(below))
    # neighbours that aren't opened go together where there are too many
    most = max(1, -(-len(order) // wide))
    runs: list[Run] = []
    for kind, folders in order:
        if kind == "tops" and runs and runs[-1].own is None and len(runs[-1].tops) < most:
            runs[-1].tops += folders
        else:
            runs.append(Run(len(runs), folders) if kind == "tops" else Run(len(runs), own=folders[0]))
    # Spark asks for at least one
    return runs or [Run(0)]


def found(run: Run, file_names: frozenset[str], skipped: frozenset[str]) -> Iterator[str]:
    """Files of a partition in the order of the walk."""
    if run.own is not None:
        yield from listed(run.own, file_names, skipped)[0]
    stack = list(reversed(run.tops))
    while stack:
        files, below = listed(stack.pop(), file_names, skipped)
        yield from files
        stack.extend(reversed(below))


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.wide = options["root"], int(options.get("wide", WIDE))
        self.names, self.skipped = (frozenset(json.loads(options[k])) for k in ("names", "skipped"))
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[Run]:
        return planned(self.root, self.names, self.skipped, self.wide)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        names = ["path", "size", "mtime_ms", "place", "content"][: 5 if self.contents else 4]
        types = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for n, path in enumerate(found(partition, self.names, self.skipped)):
            content = None
            try:
                status = os.stat(path, follow_symlinks=False)
                if self.contents:
                    with open(path, "rb") as stream:
                        content = stream.read()
            except FileNotFoundError:
                continue
            except OSError:
                # listed, but not to be read
                content = None
            row = path, status.st_size, float(status.st_mtime_ns // 1_000_000), partition.nth * PLACES + n
            rows.append((*row, content) if self.contents else row)
            held += 200 + len(content or b"")
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Walk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusloom_walk"

    def schema(self) -> str:
        return _SCHEMA + (", content binary" if self.options.get("contents", "true") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(dict(self.options))


def walk(spark: SparkSession, root: str, file_names: tuple[str, ...], skipped: tuple[str, ...], contents: bool = True, wide: int = WIDE) -> DataFrame:
    """path, size, mtime_ms, place and, unless it isn't asked for, content of the files with
    these names below a root that the driver and all executors see as a local folder."""
    spark.dataSource.register(Walk)
    reader = spark.read.format("corpusloom_walk").option("root", root).option("wide", str(wide)).option("contents", str(contents).lower())
    return reader.option("names", json.dumps(file_names)).option("skipped", json.dumps(skipped)).load()

"""Transcripts as they grow: a data source of complete lines, by byte offsets.

The offsets of a stream say up to which byte each file has been read. Only lines that have ended count, so a line that is
still being written is read by a later batch, from its first byte. A file that has become shorter than its offset was
replaced, and is read from its start; one that is gone is forgotten. Spark's checkpoint keeps the offsets, so a stream
that is stopped, or whose executors are lost, goes on where it was and gives each line once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "growing_lines"
#: Bytes that one task reads; larger files are split. Bytes that are read at a time.
PART, BLOCK = 64 << 20, 1 << 20
SCHEMA = "path string, offset long, value string"


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin at `start` or later, and before `end`."""

    path: str
    start: int
    end: int


def _files(folder: str, suffix: str) -> dict[str, int]:
    """Paths below a folder that end in `suffix`, with their sizes; any file system that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {x.path: x.size for x in found if x.is_file and x.path.endswith(suffix)}


def _open(folder: str, path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)[0].open_input_file(path)


def line_end(file, start: int, size: int) -> int:
    """The end of the last complete line between `start` and `size`, or `start` if none has ended: read from behind."""
    at = size
    while at > start:
        lo = max(start, at - BLOCK)
        file.seek(lo)
        found = file.read(at - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        at = lo
    return start


def lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the complete lines that begin in [start, end); the last may end beyond it."""
    at, rest = start, b""
    if start:
        # a line that begins before is another task's: the byte before `start` tells whether one begins here
        file.seek(start - 1)
        at = start - 1
        while True:
            block = file.read(BLOCK)
            if not block:
                return
            if (k := block.find(b"\n")) >= 0:
                at += k + 1
                break
            at += len(block)
        file.seek(at)
    while at < end or rest:
        block = file.read(BLOCK)
        if not block:
            return
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if at >= end:
                return
            yield at, part
            at += len(part) + 1
        if at >= end:
            return


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.part = options["path"], options.get("suffix", ".jsonl"), int(options.get("part", PART))

    def split(self, path: str, start: int, end: int) -> list[Stretch]:
        return [Stretch(path, lo, min(lo + self.part, end)) for lo in range(start, end, self.part)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        with _open(self.folder, partition.path) as file:
            for at, line in lines(file, partition.start, partition.end):
                yield partition.path, at, line.decode(errors="replace")


class Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        ends = {}
        for path, size in sorted(_files(self.folder, self.suffix).items()):
            with _open(self.folder, path) as file:
                ends[path] = line_end(file, 0, size)
        return [s for path, end in ends.items() for s in self.split(path, 0, end)]


class Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        """Ends of the last complete lines. Only what is new in a file is searched, from its end."""
        seen, out = getattr(self, "seen", {}), {}
        for path, size in sorted(_files(self.folder, self.suffix).items()):
            at = seen.get(path, 0)
            at = at if at <= size else 0
            with _open(self.folder, path) as file:
                out[path] = line_end(file, at, size)
        self.seen = out
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, to in now.items():
            at = was.get(path, 0)
            out += self.split(path, at if at <= to else 0, to)
        return out

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Complete lines of the files below `path` that end in `suffix` (.jsonl), as (path, offset, value)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema: StructType) -> Stream:  # noqa: N802
        return Stream(self.options)


def growing_lines(spark: SparkSession, folder: str, stream: bool = True, **options: str) -> DataFrame:
    """A stream, or a table, of (path, offset, value). `folder` is a URI or an absolute path that driver and executors see."""
    spark.dataSource.register(GrowingLines)
    reader = (spark.readStream if stream else spark.read).format(NAME)
    return reader.options(**options).load(folder)

"""A streaming source that captures the lines of growing files by byte offset.

The stream's offset is, for each file, the place behind its last complete line. A batch reads the bytes between two
offsets, so a line is taken once, when its end has been written, also over a restart. A file that is
shorter than its offset was replaced and is read from its start.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads; of its end that are searched for a line break at a time.
RANGE_BYTES, TAIL_BYTES = 32 << 20, 64 << 10
#: Lines of a batch of rows.
BATCH_LINES = 2_000
_SCHEMA = "path string, start bigint, line string"


@dataclass
class Range(InputPartition):
    """Lines of a file that start in begin..end; base is where the batch's part of the file begins."""

    path: str
    base: int
    begin: int
    end: int


def behind_last_line(open_file, size: int) -> int:
    """The place behind the last line break before size; 0 if there is none."""
    end = size
    while end > 0:
        begin = max(0, end - TAIL_BYTES)
        open_file.seek(begin)
        found = open_file.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def ranges(start: dict[str, int], end: dict[str, int], most: int = RANGE_BYTES) -> list[Range]:
    """What lies between two offsets: a file that got shorter is read from its start."""
    out = []
    for path, stop in sorted(end.items()):
        at = start.get(path, 0)
        at = 0 if at > stop else at
        out += [Range(path, at, b, min(b + most, stop)) for b in range(at, stop, most)]
    return out


def lines_of(open_file, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in the range; the last one may end behind it."""
    at = part.begin
    if part.begin > part.base:  # what began before the range belongs to the range before
        open_file.seek(part.begin - 1)
        at += len(open_file.readline()) - 1
    open_file.seek(at)
    while at < part.end:
        line = open_file.readline()
        if not line.endswith(b"\n"):
            return
        yield at, line[:-1]
        at += len(line)


class CapturedLines(DataSource):
    """Format captured_lines: path, start (byte), line of the files below the option path.

    Options: suffix (of file names, .jsonl), needle (lines without it are left out before they become rows),
    maxAgeDays (files that were last changed before that are left alone), rangeBytes.
    Names that begin with _ or a dot are left out. The offset names every file, so it grows with their number.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_lines"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        path = options["path"]
        self.scheme = re.match(r"(?:[a-z][a-z0-9]*://)?", path)[0]
        self.path, self.suffix = path, options.get("suffix", ".jsonl")
        self.needle = options.get("needle", "").encode()
        self.max_age = float(options["maxagedays"]) * 86400 if "maxagedays" in options else None
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.seen: dict[str, tuple] = {}

    def _files(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        files, folder = fs.FileSystem.from_uri(self.path)
        out = {}
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            hidden = any(part[0] in "._" for part in info.path[len(folder) :].split("/") if part)
            if info.type != fs.FileType.File or hidden or not info.path.endswith(self.suffix):
                continue
            stamp = (info.size, info.mtime_ns)
            if self.seen.get(info.path, (None,))[0] != stamp:
                if self.max_age is not None and info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 > self.max_age:
                    continue
                with files.open_input_file(info.path) as f:
                    self.seen[info.path] = (stamp, behind_last_line(f, info.size))
            out[info.path] = self.seen[info.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("line", pa.string())])
        name = f"{self.scheme}{partition.path}" if self.scheme else partition.path

        def batch(rows):
            text = [line.decode("utf-8", "replace") for _, line in rows]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array(text, pa.string())], schema=schema)

        rows = []
        with self._files().open_input_file(partition.path) as raw:
            f = _Buffered(raw)
            for at, line in lines_of(f, partition):
                if line and self.needle in line:
                    rows.append((at, line))
                    if len(rows) >= BATCH_LINES:
                        yield batch(rows)
                        rows = []
        yield batch(rows)


class _Buffered:
    """Lines of a file that can only be read in blocks."""

    def __init__(self, raw, block: int = 1 << 20) -> None:
        self.raw, self.block, self.held, self.at = raw, block, b"", 0

    def seek(self, at: int) -> None:
        self.raw.seek(at)
        self.held, self.at = b"", 0

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.held[self.at : end + 1])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.held[self.at :])
            self.held, self.at = self.raw.read(self.block), 0
            if not self.held:
                return b"".join(parts)


def captured(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The lines of the files below a folder as a stream."""
    spark.dataSource.register(CapturedLines)
    reader = spark.readStream.format("captured_lines").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()

"""Files of lines read by byte ranges, as a Python data source.

The planner lists the files and splits each into ranges; a reader seeks to its
range and owns the lines that begin there, so a file of any size is read by
many tasks, each in the memory of a batch and its longest line.  Listings read
the first 4 KiB of a file and its tail what stands behind the last line feed.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "byte_ranges"
PREFIX_BYTES = 4096
RANGE_BYTES, STEP_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
#: What a row is: a line, the number of line feeds of a range, a file with its first bytes, or a file's unfinished tail.
SCHEMAS = {
    "lines": "path string, part bigint, local bigint, begin bigint, text string",
    "counts": "path string, part bigint, feeds bigint",
    "files": "path string, size bigint, modified timestamp, prefix binary",
    "tails": "path string, offset bigint, tail string",
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a URI or a local path."""
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file://"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    return fs.FileSystem.from_uri(path)


def listing(paths: list[str], pattern: str) -> list[tuple[str, fs.FileInfo]]:
    """(uri, info) of the files at or below the paths whose names fit, each once."""
    found: dict[str, fs.FileInfo] = {}
    for root in paths:
        system, name = opened(root)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        local = isinstance(system, fs.LocalFileSystem)
        head = "file://" if local else root[: len(root) - len(name)] if root.endswith(name) else f"{urlsplit(root).scheme}://"
        for f in files:
            if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, pattern)):
                found.setdefault(head + (quote(f.path, safe="/!$&'()*+,;=:@-._~") if local else f.path), f)
    return sorted(found.items())


@dataclass
class Range(InputPartition):
    """Bytes begin to end of a file that is read up to size."""

    path: str
    begin: int
    end: int
    size: int

    def __post_init__(self):
        super().__init__(self)


class _File:
    """A file read forward in steps."""

    def __init__(self, path: str, at: int, size: int):
        system, name = opened(path)
        self.stream, self.at, self.size = system.open_input_file(name), at, size
        self.stream.seek(at)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def more(self) -> bytes:
        data = self.stream.read(min(STEP_BYTES, self.size - self.at))
        self.at += len(data)
        return data


def lines_of(r: Range) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of the complete lines that begin in a range; a line begins at 0 or behind a line feed."""
    start = max(0, r.begin - 1)
    with _File(r.path, start, r.size) as f:
        at, parts, skipping = start, [], r.begin > 0
        while data := f.more():
            pos = 0
            while (feed := data.find(b"\n", pos)) >= 0:
                parts.append(data[pos:feed])
                pos = feed + 1
                if not skipping:
                    line = parts[0] if len(parts) == 1 else b"".join(parts)
                    yield at, line
                skipping, parts, at = False, [], f.at - len(data) + pos
                if at >= r.end:
                    return
            if skipping:  # nothing begins before the range's end
                parts = []
                if f.at >= r.end:
                    return
            else:
                parts.append(data[pos:])


def feeds_of(r: Range) -> int:
    """How many complete lines begin in a range; line feeds of the bytes before each beginning are counted."""
    start, end = max(0, r.begin - 1), r.end - 1
    if r.size <= r.begin:
        return 0
    with _File(r.path, start, max(start, min(end, r.size))) as f:
        n = 0
        while data := f.more():
            n += data.count(b"\n")
    n += r.begin == 0
    # the last line that begins here counts when it ends at all
    return n - (0 if n == 0 or _ends(r) else 1)


def _ends(r: Range) -> bool:
    """Whether a line feed stands at or behind the last byte of a range."""
    with _File(r.path, r.end - 1, r.size) as f:
        while data := f.more():
            if b"\n" in data:
                return True
    return False


def tail_of(path: str, size: int) -> tuple[int, bytes]:
    """Where the bytes behind the last line feed begin, and those bytes."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        at, parts = size, []
        while at > 0:
            begin = max(0, at - STEP_BYTES)
            f.seek(begin)
            data = f.read(at - begin)
            feed = data.rfind(b"\n")
            if feed >= 0:
                return begin + feed + 1, b"".join([data[feed + 1 :], *reversed(parts)])
            parts.append(data)
            at = begin
    return 0, b"".join(reversed(parts))


class ByteRanges(DataSource):
    """Options: paths (a JSON list), pattern, rows (one of SCHEMAS), range_bytes, offsets (JSON, path to a byte on a line's beginning)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "lines")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows = options.get("rows", "lines")
        self.paths, self.pattern = json.loads(options["paths"]), options.get("pattern", "*")
        self.step, self.offsets = int(options.get("range_bytes", RANGE_BYTES)), json.loads(options.get("offsets", "{}"))

    def partitions(self) -> list[Range]:
        out = []
        for path, info in listing(self.paths, self.pattern):
            begin = int(self.offsets.get(path, 0))
            if begin > info.size:
                raise ValueError(f"{path} is read from byte {begin} on, but has {info.size}")
            if self.rows in ("files", "tails"):
                out.append(Range(path, 0, info.size, info.size))
            else:
                out += [Range(path, at, min(info.size, at + self.step), info.size) for at in range(begin, info.size, self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, r: Range) -> Iterator:
        if not r.path:
            return
        if self.rows == "lines":
            yield from self._lines(r)
        elif self.rows == "counts":
            yield r.path, r.begin, feeds_of(r)
        elif self.rows == "tails":
            offset, tail = tail_of(r.path, r.size)
            yield r.path, offset, tail.decode("utf-8", "replace")
        else:
            system, name = opened(r.path)
            info = system.get_file_info(name)
            with system.open_input_file(name) as f:
                yield r.path, info.size, info.mtime, f.read(min(PREFIX_BYTES, info.size))

    def _lines(self, r: Range) -> Iterator[pa.RecordBatch]:
        begins, texts, held, local = [], [], 0, 0

        def batch() -> pa.RecordBatch:
            n = len(begins)
            columns = [pa.array([r.path] * n), pa.array([r.begin] * n, pa.int64()), pa.array(range(local - n, local), pa.int64()), pa.array(begins, pa.int64()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["path", "part", "local", "begin", "text"])

        for begin, line in lines_of(r):
            begins.append(begin)
            texts.append(line.decode("utf-8", "replace"))
            held, local = held + len(line) + 64, local + 1
            if held >= BATCH_BYTES:
                yield batch()
                begins, texts, held = [], [], 0
        if begins:
            yield batch()


def read(spark: SparkSession, paths: tuple[str, ...], rows: str, pattern: str = "*", range_bytes: int = RANGE_BYTES, offsets: dict[str, int] | None = None) -> DataFrame:
    """Rows of one of the SCHEMAS."""
    if not getattr(spark, "_byte_ranges", False):
        spark.dataSource.register(ByteRanges)
        spark._byte_ranges = True
    options = {"paths": json.dumps(list(paths)), "pattern": pattern, "rows": rows, "range_bytes": str(range_bytes), "offsets": json.dumps(offsets or {})}
    return spark.read.format(NAME).options(**options).load()

"""Mbox archives as a splittable batch source.

``spark.read.format("mbox").option("splitBytes", n).load(path)`` gives one row per message:
``path, offset, length, raw``; (path, offset) is the key and the file order. A task owns the messages whose
separator begins in its byte range, and reads on to the next separator, so the split is exact for any range
size. ``path`` may be a file, a folder or a glob; files that only Spark's readers can open go through
``split_contents``. With ``includeRaw=false`` the bytes are not sent. Files named ``.zst`` are archives in the seekable
format of Zstandard; offsets, lengths and ranges are those of the mail within.
"""

from __future__ import annotations

import contextlib
import glob
import mmap
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import seekable

SCHEMA = "path string, offset bigint, length bigint, raw binary"
SPLIT_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000
#: Above so many ranges of a file a task takes several, one after the other: starting a task costs more than reading 1 MB.
TASKS = 1000

_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("raw", pa.large_binary())])
_DIGITS = re.compile(rb"[0-9]{4}\Z")
_SPACE = b" \t\n\x0c\r"


def is_separator(line: bytes, after_blank: bool) -> bool:
    """Is this a From_ line? It needs a ``:`` (of the time), and a year at its end or a blank line before it."""
    if not line.startswith(b"From "):
        return False
    rest = line[5:].rstrip(_SPACE)
    if not rest or rest.startswith(b" ") or b":" not in rest:
        return False
    return after_blank or bool(_DIGITS.search(rest))


Buffer = bytes | mmap.mmap | seekable.Frames


def separators(data: Buffer, start: int, end: int) -> Iterator[int]:
    """Offsets in [start, end) at which a message begins, byte 0 always among them."""
    size = len(data)
    if start == 0 and end > 0 and size:
        yield 0
    at = max(start, 1)
    while at < end:
        hit = data.find(b"\nFrom ", at - 1 if at > 1 else 1, min(size, end + 5))
        if hit < 0 or hit + 1 >= end:
            return
        at = hit + 1
        stop = data.find(b"\n", at)
        line = data[at : size if stop < 0 else stop]
        # The line before is empty: another line break stands before the one that was found.
        if is_separator(line, data[hit - 1 : hit] == b"\n" or data[max(0, hit - 2) : hit] == b"\n\r"):
            yield at
        at += 1


def ranges(data: Buffer, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the messages that begin in [start, end); the last may reach beyond."""
    previous = None
    for at in separators(data, start, end):
        if previous is not None:
            yield previous, at - previous
        previous = at
    if previous is not None:
        following = next(separators(data, max(end, previous + 1), len(data)), len(data))
        yield previous, following - previous


class ByteRanges(InputPartition):
    """[start, end) in ranges of ``split`` bytes, the last of what is left."""

    def __init__(self, path: str, start: int, end: int, split: int) -> None:
        self.path, self.start, self.end, self.split = path, start, end, split


@contextlib.contextmanager
def opened(path: str) -> Iterator[Buffer]:
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        data.madvise(mmap.MADV_SEQUENTIAL)
        yield seekable.Frames(data) if path.endswith(seekable.SUFFIX) else data


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        found = sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if os.path.isfile(p))
    else:
        found = [path] if os.path.exists(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(f"cannot open {path}")
    return found


class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.split = max(1, int(options.get("splitbytes", SPLIT_BYTES)))
        self.raw = options.get("includeraw", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files_of(self.path):
            size = os.path.getsize(path)
            if size and path.endswith(seekable.SUFFIX):
                with opened(path) as data:
                    size = len(data)
            if not size:
                raise ValueError(f"{path} is empty")
            step = self.split * -(-size // (self.split * TASKS))
            out += [ByteRanges(path, at, min(size, at + step), self.split) for at in range(0, size, step)]
        return out

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as data:
            rows: list[tuple[int, int, bytes | None]] = []
            held = 0
            for start in range(partition.start, partition.end, partition.split):
                for at, n in ranges(data, start, min(partition.end, start + partition.split)):
                    rows.append((at, n, data[at : at + n] if self.raw else None))
                    held += n * self.raw
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self._batch(partition.path, rows)
                        rows, held = [], 0
            if rows:
                yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[tuple[int, int, bytes | None]]) -> pa.RecordBatch:
        at, n, raw = zip(*rows, strict=True)
        columns = [pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=_ARROW.names)


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return MboxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MboxSource)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, include_raw: bool = True) -> DataFrame:
    register(spark)
    reader = spark.read.format("mbox").option("splitBytes", split_bytes).option("includeRaw", str(include_raw).lower())
    return reader.load(path)


def split_contents(files: DataFrame) -> DataFrame:
    """``path, content`` (as of ``binaryFile``) -> messages, for stores without local paths."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                rows = [(at, n, data[at : at + n]) for at, n in ranges(data, 0, len(data))]
                if rows:
                    yield MboxReader._batch(path, rows)

    return files.select("path", "content").mapInArrow(split, SCHEMA)

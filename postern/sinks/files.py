"""Sinks that the built-in writers cannot express: one ordered mbox file, CSV with a byte order mark,
attachment files that are never overwritten. Paths are local or on a file system mounted everywhere."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field
from ..sources import seekable

BOM = "﻿"


def check_paths(source: str, *outputs: str | None) -> None:
    """No output may be the input, or another output."""
    seen = {os.path.realpath(source): "the input"}
    for path in filter(None, outputs):
        real = os.path.realpath(path)
        if real in seen:
            raise ValueError(f"output {path} is also {seen[real]}")
        seen[real] = f"output {path}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one of ``spark.checkpoint.dir``, which the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = re.sub("^file:/+", "/", named or tempfile.gettempdir())
    if "://" in named:
        raise RuntimeError(f"{named} is not mounted: an mbox file needs a plain path")
    folder = f"{named.rstrip('/')}/postern-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def write_mbox(mail: DataFrame, path: str, column: str = "raw", ordered: bool = False) -> int:
    """Messages of ``path, offset, <column>`` in file order to one file; returns the size of the mail.

    Tasks write sorted parts beside the target; the driver joins them as streams, each removed as it is joined. A
    message that does not end with a line break gets one, unless it is the last. A target named ``.zst`` holds the mail
    in the seekable format of Zstandard. ``ordered``: the mail is dealt by ranges of its key and sorted within them."""
    staging = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(staging)
    packed = path.endswith(seekable.SUFFIX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        draft, size, ended, frames = f"{staging}/.{part}.{uuid.uuid4().hex}", 0, True, []
        with open(draft, "wb", buffering=8 << 20) as f:
            out = seekable.Writer(f) if packed else f
            for batch in batches:
                for raw in batch.column("raw").to_pylist():
                    if raw:
                        size += out.write(raw if ended else b"\n" + raw)
                        ended = raw.endswith(b"\n")
            if packed:
                out.flush()
                frames = out.sizes
        os.replace(draft, f"{staging}/{part:08d}")
        stored, held = ([pa.array([list(x)], pa.list_(pa.int32()))] for x in (zip(*frames, strict=True) if frames else ((), ())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([ended]), *stored, *held],
            names=["part", "size", "ended", "stored", "held"],
        )

    rows = mail.select("path", "offset", F.col(column).alias("raw"))
    if not ordered:
        rows = rows.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    try:
        done = rows.select("raw").mapInArrow(write, "part int, size bigint, ended boolean, stored array<int>, held array<int>")
        total, ended, frames = 0, True, []
        with open(f"{path}.tmp", "wb", buffering=8 << 20) as out:
            for part, size, ends, stored, held in sorted(done.collect()):  # one row per task
                if size:
                    if not ended:
                        last = seekable.Writer(out) if packed else out
                        total += last.write(b"\n")
                        if packed:
                            last.flush()
                            frames += last.sizes
                    total += size
                    frames += zip(stored, held, strict=True)
                    with open(f"{staging}/{part:08d}", "rb") as f:
                        shutil.copyfileobj(f, out, 8 << 20)
                    ended = ends
                os.remove(f"{staging}/{part:08d}")
            if packed:
                out.write(seekable.table(frames))
        os.replace(f"{path}.tmp", path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return total


def csv_lines(rows: DataFrame) -> DataFrame:
    """One text column ``line``: fields quoted only where they must be, null as empty."""
    fields = [csv_field(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns]
    return rows.select(F.concat_ws(",", *fields).alias("line"))


def write_csv(rows: DataFrame, path: str, header: Sequence[str] | None = None) -> int:
    """An ordered DataFrame to one file with a byte order mark; rows stream through the driver."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(BOM + ",".join(header or rows.columns) + "\n")
        for row in csv_lines(rows).toLocalIterator(prefetchPartitions=True):
            f.write(row.line + "\n")
            n += 1
    return n


def write_attachments(contents: DataFrame, folder: str) -> DataFrame:
    """``stored_as, content`` -> files in ``folder``; returns ``stored_as, is_new, warning`` (run it once).

    A file appears whole or not at all: it is written aside and linked into place, never over another. A file that
    an earlier attempt of the same task left counts as new, which the time of a marker made first tells."""
    os.makedirs(folder, exist_ok=True)
    marker = os.path.join(folder, f".began-{uuid.uuid4().hex}")
    with open(marker, "wb"):
        pass
    began = os.stat(marker).st_mtime_ns
    os.remove(marker)

    def put(name: str, content: bytes) -> bool:
        target, draft = os.path.join(folder, name), os.path.join(folder, f".{uuid.uuid4().hex}")
        try:
            with open(draft, "wb") as f:
                f.write(content)
            os.link(draft, target)
        except FileExistsError:
            return os.stat(target).st_mtime_ns >= began
        finally:
            if os.path.exists(draft):
                os.remove(draft)
        return True

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, warnings = [], []
            for name, content in zip(batch.column("stored_as").to_pylist(), batch.column("content").to_pylist(), strict=True):
                made, warning = False, None
                try:
                    made = put(name, content)
                except OSError as e:
                    warning = f"could not save {name}: {e}"
                new.append(made), warnings.append(warning)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stored_as"), pa.array(new, pa.bool_()), pa.array(warnings, pa.string())],
                names=["stored_as", "is_new", "warning"],
            )

    return contents.select("stored_as", "content").mapInArrow(write, "stored_as string, is_new boolean, warning string")

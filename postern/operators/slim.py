"""Attachment stripping and extraction over kept messages.

Extraction names files by content: the first occurrence in file order gives the name, which is a
distributed minimum per content hash, not a shared table. Stripping alone needs no shuffle; with
extraction only (hash, key, name) rows cross the network, never the mail.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.text import human_bytes_py, sanitize
from .rules import Options

KEY = ("path", "offset")
_LENGTH_LINE = re.compile(rb"(?im)^content-length:[^\n]*(?:\n|\Z)")


def eligible(raw: bytes, least: int) -> list[tuple[int, mime.Part]]:
    """(index among the leaves, part) of the attachments that may be stripped or extracted."""
    found = enumerate(mime.parts(raw))
    return [(i, p) for i, p in found if p.is_attachment and not p.top_level and p.estimated_size(raw) >= least]


def _safe(raw: bytes, least: int) -> list[tuple[int, mime.Part]]:
    try:
        return eligible(raw, least)
    except Exception:  # noqa: BLE001  an unparseable message is kept byte for byte
        return []


def _extractor(least: int, content: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "leaf", "name", "ctype", "bytes", "estimated", "sha256", *(["content"] if content else [])]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = []
            for path, offset, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "raw")), strict=True):
                for leaf, part in _safe(raw or b"", least):
                    data = part.decoded(raw)
                    digest = hashlib.sha256(data).hexdigest()
                    row = [path, offset, leaf, part.name(), part.ctype, len(data), part.estimated_size(raw), digest]
                    rows.append([*row, data] if content else row)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return extract


def attachments(kept: DataFrame, opts: Options, content: bool = False) -> DataFrame:
    """``path, offset, raw`` -> one row per eligible attachment, with its decoded length and hash."""
    schema = "path string, offset bigint, leaf int, name string, ctype string, bytes bigint, estimated bigint, sha256 string"
    schema += ", content binary" if content else ""
    rows = kept.select("path", "offset", "raw")
    return rows.mapInArrow(_extractor(opts.min_attachment_kb * 1024, content), schema)


def stored_names(found: DataFrame) -> DataFrame:
    """``sha256, stored_as, first``: the name of each content, from its first occurrence in file order."""
    first = F.min(F.struct("path", "offset", "leaf", "name")).alias("first")
    named = found.groupBy("sha256").agg(first)
    stored = F.concat(F.substring("sha256", 1, 16), F.lit("_"), sanitize(F.col("first.name")))
    return named.select("sha256", stored.alias("stored_as"), F.struct("first.path", "first.offset", "first.leaf").alias("first"))


def extract(kept: DataFrame, opts: Options) -> DataFrame:
    """One row per extracted attachment: ``path, offset, leaf, name, bytes, sha256, stored_as, is_first``."""
    found = attachments(kept, opts)
    rows = found.join(stored_names(found), "sha256")
    is_first = F.struct("path", "offset", "leaf") == F.col("first")
    return rows.select(*KEY, "leaf", "name", "ctype", "bytes", "estimated", "sha256", "stored_as", is_first.alias("is_first"))


def extract_totals(found: DataFrame) -> DataFrame:
    """``attachments, files, bytes`` of the rows of ``attachments`` or ``extract``: contents are counted once each.
    Counts combine before the shuffle, so a logo in every message is one row per task."""
    each = found.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    zero = F.lit(0)
    return each.agg(
        F.coalesce(F.sum("n"), zero).cast("long").alias("attachments"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), zero).cast("long").alias("bytes"),
    )


def placeholder(part: mime.Part, size: int, stored: str | None, newline: str, tool: str) -> bytes:
    """The text part that stands where an attachment was."""
    name = re.sub(r"[\r\n]", " ", part.name())
    saved = f", saved as {stored}" if stored else ""
    title = tool[:1].upper() + tool[1:]
    lines = (
        "Content-Type: text/plain; charset=utf-8",
        "Content-Transfer-Encoding: 8bit",
        "Content-Disposition: inline",
        f"X-{title}-Stripped: {part.ctype}",
        "",
        f'[Attachment removed by {tool}: "{name}" ({part.ctype}, {human_bytes_py(size)}){saved}]',
    )
    return newline.join(lines).encode("utf-8", "replace")


def stripped_message(raw: bytes, least: int, stored: dict[int, str], tool: str) -> tuple[bytes, int, int]:
    """(new message, parts replaced, raw bytes replaced)."""
    newline = "\r\n" if b"\r\n" in raw[:4096] else "\n"
    cuts = [
        (p.start, p.end, placeholder(p, p.estimated_size(raw), stored.get(leaf), newline, tool)) for leaf, p in eligible(raw, least)
    ]
    if not cuts:
        return raw, 0, 0
    count, size = len(cuts), sum(end - start for start, end, _ in cuts)
    start = mime.after_from_line(raw)
    head, _ = mime.head_and_body(raw, start, len(raw))
    if line := _LENGTH_LINE.search(raw[start:head]):  # it would be wrong now
        cuts.append((start + line.start(), start + line.end(), b""))
    out, at = [], 0
    for begin, end, text in sorted(cuts, key=lambda c: c[0]):
        if begin >= at:
            out += [raw[at:begin], text]
            at = end
    out.append(raw[at:])
    return b"".join(out), count, size


def _stripper(least: int, tool: str, along: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, sizes = [], [], []
            for raw, saved in zip(batch.column("raw").to_pylist(), batch.column("__saved").to_pylist(), strict=True):
                stored = {s["leaf"]: s["stored_as"] for s in saved or ()}
                try:
                    new, n, size = stripped_message(raw or b"", least, stored, tool)
                except Exception:  # noqa: BLE001  an unparseable message is kept byte for byte
                    new, n, size = raw, 0, 0
                out.append(new), counts.append(n), sizes.append(size)
            columns = [*(batch.column(c) for c in along), pa.array(out, pa.binary())]
            columns += [pa.array(counts, pa.int32()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*along, "out_raw", "stripped", "stripped_bytes"])

    return strip


def strip(kept: DataFrame, opts: Options, extracted: DataFrame | None = None) -> DataFrame:
    """``path, offset, raw`` -> ``path, offset, out_raw, stripped, stripped_bytes``, and ``sender`` where it is given.

    With ``extracted`` the placeholders name the saved files."""
    along = ["path", "offset", *(c for c in kept.columns if c == "sender")]
    rows = kept.select(*along, "raw")
    saved = "array<struct<leaf:int,stored_as:string>>"
    if extracted is None:
        rows = rows.withColumn("__saved", F.lit(None).cast(saved))
    else:
        names = extracted.groupBy(*KEY).agg(F.collect_list(F.struct("leaf", "stored_as")).alias("__saved"))
        rows = rows.join(names, list(KEY), "left")
    schema = "path string, offset bigint, " + ("sender string, " if "sender" in along else "") + "out_raw binary, stripped int, stripped_bytes bigint"
    return rows.mapInArrow(_stripper(opts.min_attachment_kb * 1024, opts.tool_name, along), schema)


def kept_totals(stripped: DataFrame) -> DataFrame:
    size = F.octet_length("out_raw").cast("long")
    return stripped.agg(
        F.count(F.lit(1)).alias("kept"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("out_bytes"),
        F.coalesce(F.sum("stripped"), F.lit(0)).cast("long").alias("stripped"),
        F.coalesce(F.sum("stripped_bytes"), F.lit(0)).cast("long").alias("stripped_bytes"),
    )


def kept_domains(stripped: DataFrame) -> DataFrame:
    """Messages and output bytes per sender domain of ``strip``'s rows with their senders."""
    domain = F.substring_index(F.coalesce("sender", F.lit("")), "@", -1)
    rows = stripped.select(domain.alias("domain"), F.octet_length("out_raw").cast("long").alias("out"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("msgs"), F.sum("out").cast("long").alias("bytes"))

"""Messages to rows: header fields, labels, bulk flag, attachment counts.

One pass over Arrow batches parses each message once and drops the raw bytes; addresses are taken apart
afterwards by native expressions. A message that cannot be parsed becomes a row with its size and the
subject ``(unparseable)``; its sender is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.text import extract_addrs

WANTED = frozenset(
    "from to cc bcc subject date list-unsubscribe list-id precedence x-gmail-labels content-length".split()
)
UNPARSEABLE = "(unparseable)"

_FIELDS = {
    "from_header": pa.string(),
    "to_header": pa.string(),
    "cc_header": pa.string(),
    "bcc_header": pa.string(),
    "subject": pa.string(),
    "date": pa.string(),
    "bulk": pa.bool_(),
    "labels": pa.list_(pa.string()),
    "att_count": pa.int32(),
    "att_bytes": pa.int64(),
    "att_names": pa.list_(pa.string()),
}
_TYPES = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "bigint"}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_TYPES.get(t, 'array<string>')}" for k, t in fields.items())


def header_fields(raw: bytes) -> dict[str, object]:
    start = mime.after_from_line(raw)
    head, _ = mime.head_and_body(raw, start, len(raw))
    found = mime.headers(raw[start:head], WANTED)
    return {
        "from_header": mime.first(found, "from"),
        "to_header": mime.first(found, "to"),
        "cc_header": mime.first(found, "cc"),
        "bcc_header": mime.first(found, "bcc"),
        "subject": mime.decode_words(mime.first(found, "subject") or ""),
        "date": mime.first(found, "date") or "",
        "bulk": mime.is_bulk(found),
        "labels": mime.labels(found),
    }


def attachment_fields(raw: bytes) -> dict[str, object]:
    found = [p for p in mime.parts(raw) if p.is_attachment]
    return {
        "att_count": len(found),
        "att_bytes": sum(p.estimated_size(raw) for p in found),
        "att_names": [p.filename for p in found if p.filename is not None],
    }


def fields(raw: bytes, walk: bool) -> dict[str, object]:
    try:
        return header_fields(raw) | (attachment_fields(raw) if walk else {})
    except Exception:  # noqa: BLE001  one bad message must not end the run
        empty = {"subject": UNPARSEABLE, "date": "", "bulk": False, "labels": []}
        return empty | ({"att_count": 0, "att_bytes": 0, "att_names": []} if walk else {})


def _parser(keep: list[str], walk: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = {k: t for k, t in _FIELDS.items() if walk or not k.startswith("att_")}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fields(raw or b"", walk) for raw in batch.column("raw").to_pylist()]
            columns = [batch.column(k) for k in keep]
            columns += [pa.array([r.get(k) for r in rows], t) for k, t in wanted.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *wanted])

    return parse


def analyze(mail: DataFrame, walk: bool = True, keep_raw: bool = False) -> DataFrame:
    """``path, offset, length, raw`` -> one row per message. Without ``walk`` only headers are read."""
    keep = ["path", "offset", "length", *(["raw"] if keep_raw else [])]
    wanted = {k: t for k, t in _FIELDS.items() if walk or not k.startswith("att_")}
    schema = "path string, offset bigint, length bigint, " + ("raw binary, " if keep_raw else "") + _ddl(wanted)
    rows = mail.select("path", "offset", "length", "raw").mapInArrow(_parser(keep, walk), schema)
    return rows.select(
        *keep,
        F.col("length").alias("size"),
        F.get(extract_addrs(F.col("from_header")), F.lit(0)).alias("sender"),
        extract_addrs(F.col("to_header")).alias("to"),
        extract_addrs(F.col("cc_header")).alias("cc"),
        extract_addrs(F.col("bcc_header")).alias("bcc"),
        *[c for c in wanted if not c.endswith("_header")],
    )

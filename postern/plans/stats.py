"""The statistics program: reports, totals and largest messages of an archive, as files and as text."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes_py
from ..operators import messages, reports
from ..sinks import files
from ..sources import mbox

KEY_NAMES = {
    "labels": "label",
    "received_senders": "sender",
    "received_sender_domains": "domain",
    "received_to": "receiver",
    "received_cc": "cc",
    "sent_to": "receiver",
    "sent_cc": "cc",
    "sent_bcc": "bcc",
    "sent_to_domains": "domain",
}
COLUMNS = ["messages", "size_mb", "attachments", "attachment_mb", "bulk_messages", "pct_of_total_size"]


@dataclass
class StatsOptions:
    me: tuple[str, ...] = ()
    out: str | None = None
    top: int = 25
    by: str = "domain"
    largest: int = 1000
    csv: bool = True
    split_bytes: int = mbox.SPLIT_BYTES


def output_folder(spark: SparkSession, out: str | None) -> str:
    if out:
        return out
    stamp = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd-HHmmss'Z'"))
    return f"mbox_stats_{stamp.first()[0]}"


def run(spark: SparkSession, path: str, opts: StatsOptions) -> Iterator[str]:
    """Writes the reports and yields the lines of the summary."""
    began = time.monotonic()
    mail = mbox.read(spark, path, opts.split_bytes)
    # Only metadata is kept for the several reports, never the mail.
    msgs = messages.analyze(mail).persist()
    try:
        tot = reports.totals(msgs, opts.me).first()
        rep = reports.reports(msgs, opts.me).persist()
        seconds = time.monotonic() - began
        yield f"{path}: {tot.messages} messages, {human_bytes_py(tot.bytes)} in {seconds:.1f} s"
        yield f"received {tot.received_messages}, sent {tot.sent_messages}, bulk {tot.bulk_messages} ({human_bytes_py(tot.bulk_bytes)})"
        share = min(100.0, 100.0 * (tot.attachment_bytes * 4 // 3) / max(tot.bytes, 1))
        yield f"attachments {tot.attachments}, {human_bytes_py(tot.attachment_bytes)} decoded, about {share:.1f}% of the archive"
        if not opts.me and (own := reports.detected_me(msgs).first()):
            yield f"own address, as it seems: {own.sender} ({own.n} messages sent)"
        yield from _table(rep, f"received_sender{'s' if opts.by == 'sender' else '_domains'}", opts.top, tot)
        for dim in ("labels", "sent_to_domains"):
            yield from _table(rep, dim, opts.top, tot)
        if opts.csv:
            folder = output_folder(spark, opts.out)
            os.makedirs(folder, exist_ok=True)
            yield from _files(spark, path, folder, msgs, rep, tot, seconds, opts)
    finally:
        msgs.unpersist()


def _table(rep: DataFrame, dim: str, n: int, tot: Row) -> Iterator[str]:
    rows = reports.ordered(rep.where(F.col("dim") == dim)).limit(n).collect()
    if rows:
        yield f"\n{dim.replace('_', ' ')}:"
    for r in rows:
        key = r.key if len(r.key) <= 60 else r.key[:59] + "…"
        yield f"{human_bytes_py(r.bytes):>10} {r.msgs:>8} {100 * r.bytes / max(tot.bytes, 1):5.1f}%  {key}"


def _files(spark, path, folder, msgs, rep, tot, seconds, opts) -> Iterator[str]:  # noqa: ANN001
    for dim, key in KEY_NAMES.items():
        rows = rep.where(F.col("dim") == dim)
        if rows.limit(1).count():
            text = reports.report_rows(reports.ordered(rows), F.lit(tot.bytes))
            files.write_csv(text, f"{folder}/{dim}.csv", [key, *COLUMNS])
            yield f"wrote {folder}/{dim}.csv"
    general = reports.general_rows(spark.createDataFrame([tot]), path, seconds)
    files.write_csv(general, f"{folder}/general.csv")
    if opts.largest:
        top = reports.largest(msgs, opts.largest)
        files.write_csv(top.drop("path", "offset"), f"{folder}/largest_messages.csv")
    yield f"wrote {folder}/general.csv and largest_messages.csv"

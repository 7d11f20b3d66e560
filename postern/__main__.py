"""``python -m postern stats|slim ARCHIVE ...``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import rules
from .plans import slim, stats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="postern", description="Analyse and reduce mbox archives.")
    p.add_argument("--threads", type=int, help="local cores to use (a cluster's master is left alone)")
    p.add_argument("--version", action="version", version="postern 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("stats", help="reports by sender, domain, receiver and label")
    s.add_argument("mbox")
    s.add_argument("--me", action="append", default=[], metavar="ADDR")
    s.add_argument("-o", "--out")
    s.add_argument("--top", type=int, default=25)
    s.add_argument("--by", choices=["domain", "sender"], default="domain")
    s.add_argument("--largest", type=int, default=1000)
    s.add_argument("--no-csv", action="store_true")
    r = sub.add_parser("slim", help="a smaller archive")
    r.add_argument("mbox")
    r.add_argument("-o", "--out")
    for name in ("--drop", "--keep", "--keep-file", "--drop-label"):
        r.add_argument(name, action="append", default=[])
    r.add_argument("--drop-file", "--senders", action="append", default=[], dest="drop_file")
    for name in ("--drop-bulk", "--strip-attachments", "--dry-run"):
        r.add_argument(name, action="store_true")
    r.add_argument("--min-attachment-kb", type=int, default=0)
    r.add_argument("--extract-attachments", metavar="DIR")
    r.add_argument("--dropped-out")
    r.add_argument("--dropped-csv")
    return p


def slim_options(a: argparse.Namespace) -> slim.SlimOptions:
    rule = rules.Rules(
        drop=rules.compile_patterns(a.drop, a.drop_file),
        keep=rules.compile_patterns(a.keep, a.keep_file),
        labels=a.drop_label,
        bulk=a.drop_bulk,
    )
    extract = a.extract_attachments is not None
    opts = rules.Options(strip=a.strip_attachments, extract=extract, min_attachment_kb=a.min_attachment_kb)
    return slim.SlimOptions(a.out, a.dropped_out, a.dropped_csv, a.extract_attachments, a.dry_run, rule, opts)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("postern").config("spark.sql.session.timeZone", "UTC")
    if a.threads:
        builder = builder.master(f"local[{max(1, a.threads)}]")
    spark = builder.getOrCreate()
    try:
        if a.command == "stats":
            opts = stats.StatsOptions(tuple(a.me), a.out, a.top, a.by, 0 if a.no_csv else a.largest, not a.no_csv)
            lines = stats.run(spark, a.mbox, opts)
        else:
            lines = slim.run(spark, a.mbox, slim_options(a))
        for line in lines:
            print(line)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

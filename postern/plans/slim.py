"""The reduction program: drop by rules, strip and extract attachments, write archives and audit files.

Rules look at headers only and are decided where a message is parsed; the MIME structure is walked for the
survivors alone, in the same stage, so the mail itself crosses no shuffle before it is written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes_py, mib, number
from ..operators import messages, rules, slim
from ..operators.rules import Options, Rules
from ..sinks import files
from ..sources import mbox

DROPPED_COLUMNS = ["reason", "matched_pattern", "from", "date", "subject", "size_kb"]
INDEX_COLUMNS = ["stored_as", "original_name", "size_mb", "first_seen", "from", "date", "subject"]


@dataclass
class SlimOptions:
    out: str | None = None
    dropped_out: str | None = None
    dropped_csv: str | None = None
    extract_to: str | None = None
    dry_run: bool = False
    rules: Rules = field(default_factory=Rules)
    options: Options = field(default_factory=Options)
    split_bytes: int = mbox.SPLIT_BYTES

    def check(self, source: str) -> None:
        if not (self.rules or self.options.strip or self.options.extract):
            raise ValueError("nothing to do: give a drop rule, or ask for attachments to be stripped or extracted")
        if not self.out and not self.dry_run:
            raise ValueError("an output file is required unless this is a dry run")
        files.check_paths(source, self.out, self.dropped_out, self.dropped_csv)


@dataclass
class Plan:
    """The lazy tables of a run; a dry run only aggregates over them."""

    classified: DataFrame
    kept: DataFrame
    dropped: DataFrame
    extracted: DataFrame | None
    out: DataFrame


def plan(mail: DataFrame, rule: Rules, opts: Options) -> Plan:
    """Each table comes from the mail by one scan and one parse, without a shuffle of it."""
    classified = rules.classify(messages.analyze(mail, walk=False), rule)
    if rule:
        whole = rules.classify(messages.analyze(mail, walk=False, keep_raw=True), rule).select("path", "offset", "raw", "sender", "reason")
        kept, dropped = whole.where("reason IS NULL").drop("reason"), whole.where("reason IS NOT NULL").drop("reason")
    else:
        kept = messages.analyze(mail, walk=False, keep_raw=True).select("path", "offset", "raw", "sender")
        dropped = kept.where("false")
    extracted = slim.extract(kept, opts) if opts.extract else None
    if opts.strip:
        out = slim.strip(kept, opts, extracted)
    else:
        none = (F.lit(0).alias("stripped"), F.lit(0).cast("long").alias("stripped_bytes"))
        out = kept.select("path", "offset", "sender", F.col("raw").alias("out_raw"), *none)
    return Plan(classified, kept, dropped, extracted, out)


def dropped_rows(classified: DataFrame, patterns: list) -> DataFrame:
    """Every dropped message in file order with its reason and pattern."""
    table = rules.patterns_df(classified.sparkSession, patterns).select(F.col("idx").alias("rule_idx"), "pattern")
    rows = classified.where("reason IS NOT NULL").join(table, "rule_idx", "left").orderBy("path", "offset")
    return rows.select(
        "reason",
        F.coalesce("pattern", F.lit("")).alias("matched_pattern"),
        F.coalesce("sender", F.lit("")).alias("from"),
        "date",
        "subject",
        number(F.col("size") / F.lit(1024.0), "0.0").alias("size_kb"),
    )


def index_rows(extracted: DataFrame, classified: DataFrame) -> DataFrame:
    """The attachment index in file order."""
    about = classified.select("path", "offset", F.coalesce("sender", F.lit("")).alias("from"), "date", "subject")
    rows = extracted.join(about, ["path", "offset"], "left").orderBy("path", "offset", "leaf")
    seen = F.when(F.col("is_first"), "yes").otherwise("duplicate")
    return rows.select("stored_as", F.col("name").alias("original_name"), mib(F.col("bytes")).alias("size_mb"), seen.alias("first_seen"), "from", "date", "subject")


def run(spark: SparkSession, path: str, opts: SlimOptions) -> Iterator[str]:
    """Writes what is asked for and yields the lines of the summary."""
    opts.check(path)
    mail = mbox.read(spark, path, opts.split_bytes)
    p = plan(mail, opts.rules, opts.options)
    p.classified.persist()
    try:
        size = p.classified.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        yield f"input: {size.n} messages, {human_bytes_py(size.b)}"
        for r in rules.dropped_by_reason(p.classified).orderBy("reason").collect():
            yield f"dropped by {r.reason}: {r.msgs} messages, {human_bytes_py(r.bytes)} ({100 * r.bytes / max(size.b, 1):.1f}%)"
        kept = slim.kept_totals(p.out).first()
        if opts.options.strip:
            yield f"stripped: {kept.stripped} attachments, {human_bytes_py(kept.stripped_bytes)}"
        if p.extracted is not None:
            got = slim.extract_totals(p.extracted).first()
            yield f"extracted: {got.attachments} attachments, {got.files} files, {human_bytes_py(got.bytes)}"
        yield f"output: {kept.kept} messages, {human_bytes_py(kept.out_bytes)} ({100 * kept.out_bytes / max(size.b, 1):.1f}% of the input)"
        if opts.rules.drop:
            hits = rules.rule_hits(p.classified, opts.rules.drop)
            missed = hits.where("msgs = 0").orderBy("idx")
            n = missed.count()
            yield f"patterns: {len(opts.rules.drop)}, of which {n} matched nothing"
            for r in missed.limit(50).collect():
                yield f"  {r.pattern}"
            if n > 50:
                yield f"  … and {n - 50} more"
        yield from _top("largest dropped senders", rules.dropped_senders(p.classified).withColumnRenamed("sender", "key"))
        domains = slim.kept_domains(p.out)
        yield from _top("largest remaining domains", domains.withColumnRenamed("domain", "key"))
        if not opts.dry_run:
            yield from _write(p, opts)
    finally:
        p.classified.unpersist()


def _top(title: str, rows: DataFrame) -> Iterator[str]:
    found = rows.orderBy(F.desc("bytes"), F.desc("msgs"), "key").limit(15).collect()
    if found:
        yield f"\n{title}:"
    for r in found:
        key = r.key or "(unknown)"
        yield f"{human_bytes_py(r.bytes):>10} {r.msgs:>8}  {key if len(key) <= 60 else key[:59] + '…'}"


def _write(p: Plan, opts: SlimOptions) -> Iterator[str]:
    if p.extracted is not None and opts.extract_to:
        os.makedirs(opts.extract_to, exist_ok=True)
        contents = slim.attachments(p.kept, opts.options, content=True)
        first = p.extracted.where("is_first").select("path", "offset", "leaf", "stored_as")
        done = files.write_attachments(contents.join(first, ["path", "offset", "leaf"]), opts.extract_to).persist()
        for r in done.where("warning IS NOT NULL").collect():
            yield f"warning: {r.warning}"
        # A file that was there before counts as a duplicate.
        old = done.where("NOT is_new").select("stored_as").distinct()
        marked = p.extracted.join(old.withColumn("__old", F.lit(True)), "stored_as", "left")
        marked = marked.withColumn("is_first", F.col("is_first") & F.col("__old").isNull())
        files.write_csv(index_rows(marked, p.classified), f"{opts.extract_to}/attachments_index.csv", INDEX_COLUMNS)
        done.unpersist()
        yield f"attachment index: {opts.extract_to}/attachments_index.csv"
    if opts.out:
        files.write_mbox(p.out, opts.out, "out_raw")
        yield f"kept mail: {opts.out}"
    if opts.dropped_out:
        files.write_mbox(p.dropped, opts.dropped_out)
        yield f"dropped mail: {opts.dropped_out}"
    if opts.dropped_csv:
        files.write_csv(dropped_rows(p.classified, list(opts.rules.drop)), opts.dropped_csv, DROPPED_COLUMNS)
        yield f"dropped list: {opts.dropped_csv}"

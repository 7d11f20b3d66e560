"""Grouped size and count reports over analysed messages.

All grouped reports come from one pass: each message is exploded into its (dim, key) pairs and one
partial-and-final aggregation serves every dimension, so the raw mail is read once and what is shuffled is
one row per key and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_of, mib, percent

UNKNOWN = "(unknown)"
SENT_LABEL = "Sent"
DIMS = (
    "labels",
    "received_senders",
    "received_sender_domains",
    "received_to",
    "received_cc",
    "sent_to",
    "sent_cc",
    "sent_bcc",
    "sent_to_domains",
)


def is_sent(me: Sequence[str] = (), label: str = SENT_LABEL) -> Column:
    """By own addresses if they are given, else by the label (case-sensitive); no sender: received."""
    own = [a.strip().lower() for a in me]
    test = F.col("sender").isin(own) if own else F.array_contains("labels", label)
    return F.when(F.col("sender").isNull(), False).otherwise(F.coalesce(test, F.lit(False)))


def _pairs(dim: str, keys: Column) -> Column:
    return F.transform(keys, lambda key: F.struct(F.lit(dim).alias("dim"), key.alias("key")))


def dim_rows(msgs: DataFrame, me: Sequence[str] = (), dims: Sequence[str] = DIMS, label: str = SENT_LABEL) -> DataFrame:
    """One row per message and (dim, key)."""
    sent = F.col("__sent")
    none = F.array().cast("array<string>")
    sender = F.coalesce("sender", F.lit(UNKNOWN))
    people = F.concat("to", "cc", "bcc")
    keys = {
        "labels": F.col("labels"),
        "received_senders": F.when(sent, none).otherwise(F.array(sender)),
        "received_sender_domains": F.when(sent, none).otherwise(F.array(domain_of(sender))),
        "received_to": F.when(sent, none).otherwise(F.col("to")),
        "received_cc": F.when(sent, none).otherwise(F.col("cc")),
        "sent_to": F.when(sent, F.col("to")).otherwise(none),
        "sent_cc": F.when(sent, F.col("cc")).otherwise(none),
        "sent_bcc": F.when(sent, F.col("bcc")).otherwise(none),
        "sent_to_domains": F.when(sent, F.array_distinct(F.transform(people, domain_of))).otherwise(none),
    }
    pairs = F.flatten(F.array(*[_pairs(d, keys[d]) for d in dims]))
    rows = msgs.withColumn("__sent", is_sent(me, label))
    return rows.select(F.explode(pairs).alias("p"), "size", "att_count", "att_bytes", "bulk").select(
        "p.dim", "p.key", "size", "att_count", "att_bytes", "bulk"
    )


def aggregates(*keys: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("msgs"),
        F.sum("size").cast("long").alias("bytes"),
        F.sum("att_count").cast("long").alias("att"),
        F.sum("att_bytes").cast("long").alias("att_bytes"),
        F.sum(F.col("bulk").cast("long")).cast("long").alias("bulk"),
    ]


def reports(msgs: DataFrame, me: Sequence[str] = (), dims: Sequence[str] = DIMS) -> DataFrame:
    """``dim, key, msgs, bytes, att, att_bytes, bulk`` for all dimensions in one shuffle."""
    return dim_rows(msgs, me, dims).groupBy("dim", "key").agg(*aggregates())


def report(msgs: DataFrame, dim: str, me: Sequence[str] = ()) -> DataFrame:
    return reports(msgs, me, (dim,)).drop("dim")


def ordered(rep: DataFrame) -> DataFrame:
    """Largest first; ties by messages, then key."""
    return rep.orderBy(F.desc("bytes"), F.desc("msgs"), "key")


def report_rows(rep: DataFrame, total_bytes: Column) -> DataFrame:
    """The seven text columns of a report file."""
    return rep.select(
        "key",
        F.col("msgs").cast("string").alias("messages"),
        mib(F.col("bytes")).alias("size_mb"),
        F.col("att").cast("string").alias("attachments"),
        mib(F.col("att_bytes")).alias("attachment_mb"),
        F.col("bulk").cast("string").alias("bulk_messages"),
        percent(F.col("bytes"), total_bytes).alias("pct_of_total_size"),
    )


def totals(msgs: DataFrame, me: Sequence[str] = (), label: str = SENT_LABEL) -> DataFrame:
    """One row of global counts; distinct counts are exact.

    One pass and one shuffle: every message gives its keys and one row for itself, these combine by key, and
    a distinct count is the number of keys of its kind."""
    none = F.array().cast("array<string>")
    sent, bulk = F.col("__sent"), F.col("bulk")
    sender = F.coalesce("sender", F.lit(UNKNOWN))
    flags = F.concat(sent.cast("int"), bulk.cast("int"), (F.size("labels") > 0).cast("int"))
    keys = {
        "all": F.array(flags),
        "senders": F.when(sent, none).otherwise(F.array(sender)),
        "domains": F.when(sent, none).otherwise(F.array(domain_of(sender))),
        "people": F.when(sent, F.col("to")).otherwise(none),
    }
    pairs = F.flatten(F.array(*[_pairs(d, k) for d, k in keys.items()]))
    rows = msgs.withColumn("__sent", is_sent(me, label)).select(F.explode(pairs).alias("p"), "size", "att_count", "att_bytes")
    sums = [F.sum(c).cast("long").alias(c) for c in ("size", "att_count", "att_bytes")]
    each = rows.groupBy("p.dim", "p.key").agg(F.count(F.lit(1)).alias("n"), *sums)

    def summed(column: str, at: int | None = None, value: str = "1") -> Column:
        test = F.col("dim") == "all"
        test = test if at is None else test & (F.substring("key", at, 1) == value)
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("long")

    def distinct(dim: str) -> Column:
        return F.count(F.when(F.col("dim") == dim, 1))

    return each.agg(
        summed("n").alias("messages"),
        summed("size").alias("bytes"),
        summed("att_count").alias("attachments"),
        summed("att_bytes").alias("attachment_bytes"),
        summed("n", 2).alias("bulk_messages"),
        summed("size", 2).alias("bulk_bytes"),
        summed("n", 1).alias("sent_messages"),
        summed("size", 1).alias("sent_bytes"),
        summed("n", 1, "0").alias("received_messages"),
        summed("size", 1, "0").alias("received_bytes"),
        (summed("n", 3) > 0).alias("has_labels"),
        distinct("senders").alias("unique_received_senders"),
        distinct("domains").alias("unique_received_sender_domains"),
        distinct("people").alias("unique_people_you_wrote_to"),
    )


#: Metric rows of the general report: name, expression on ``totals``.
METRICS: tuple[tuple[str, str], ...] = (
    ("messages", "messages"),
    ("total_mb", "mb:bytes"),
    ("attachments", "attachments"),
    ("attachment_mb_decoded", "mb:attachment_bytes"),
    ("bulk_messages", "bulk_messages"),
    ("bulk_mb", "mb:bulk_bytes"),
    ("sent_messages", "sent_messages"),
    ("sent_mb", "mb:sent_bytes"),
    ("received_messages", "received_messages"),
    ("received_mb", "mb:received_bytes"),
    ("unique_received_senders", "unique_received_senders"),
    ("unique_received_sender_domains", "unique_received_sender_domains"),
    ("unique_people_you_wrote_to", "unique_people_you_wrote_to"),
)


def general_rows(tot: DataFrame, file: str | None = None, scan_seconds: float | None = None) -> DataFrame:
    """``metric, value`` as text, one row per metric."""
    rows = [] if file is None else [("file", F.lit(file))]
    for name, source in METRICS:
        kind, _, column = source.rpartition(":")
        rows.append((name, mib(F.col(column)) if kind else F.col(column).cast("string")))
    if scan_seconds is not None:
        rows.append(("scan_seconds", F.lit(f"{scan_seconds:.1f}")))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in rows])
    return tot.select(F.explode(pairs).alias("r")).select("r.metric", "r.value")


def detected_me(msgs: DataFrame, label: str = SENT_LABEL) -> DataFrame:
    """The most frequent sender of sent mail (``sender, n``, at most one row); ties go to the greatest address."""
    sent = msgs.where(is_sent((), label)).groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    best = sent.agg(F.max(F.struct("n", "sender")).alias("m"))
    return best.where("m IS NOT NULL").select("m.sender", "m.n")


def largest(msgs: DataFrame, k: int = 1000) -> DataFrame:
    """The k largest messages with the columns of their report."""
    top = msgs.orderBy(F.desc("size"), "path", "offset").limit(k)
    return top.select(
        "path",
        "offset",
        "size",
        "date",
        F.coalesce("sender", F.lit("")).alias("from"),
        F.array_join("to", "; ").alias("to"),
        "subject",
        F.array_join("labels", "; ").alias("labels"),
        "att_count",
        F.array_join("att_names", "; ").alias("att_names"),
    )

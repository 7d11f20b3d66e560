"""Sender patterns and drop rules.

A pattern is exact (``a@b.c``), a domain with its subdomains (``b.c`` or ``@b.c``) or a ``*`` glob. Pattern lists come
from the command line or a file on the driver, so a rule is a function of one message: ``classify`` decides
it where the message is parsed, in the same stage, by hash lookups (the address, and every dot suffix of its
domain) and then the globs, once per distinct sender of a batch. ``match`` says the same of a table of
senders against a table of patterns by joins, for lists that are tables themselves.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.text import ascii_lower, domain_of, domain_suffixes, glob_like

# First header cells that mark a report file used as a list.
CSV_HEADERS = ("sender,", "domain,", "receiver,", "cc,", "bcc,")
BOM = "﻿"
BROADCAST_PATTERNS = 1_000_000
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse_list_line(line: str, csv: bool = False) -> list[str]:
    """The patterns of one line of a sender list; in CSV mode its first cell."""
    line = line.strip().lstrip(BOM)
    if not line or line.startswith("#"):
        return []
    if csv:
        cell = line[1:].partition('"')[0] if line.startswith('"') else line.partition(",")[0]
        cell = cell.strip().translate(_ASCII_LOWER)
        return [cell] if cell else []
    if "<" in line:
        return mime.addresses(line)
    words = (w.strip("\"'") for w in re.split(r"[,;\s]+", line))
    return [w for w in (re.sub(r"\A(?:mailto:)+", "", w).translate(_ASCII_LOWER) for w in words) if w]


def parse_list(text: str) -> list[str]:
    """A whole list file; a report file is recognised by its header line."""
    lines = text.split("\n")
    csv = bool(lines) and lines[0].lstrip(BOM).strip().lower().startswith(CSV_HEADERS)
    return [p for line in lines[csv:] for p in parse_list_line(line, csv)]


def read_list(path: str) -> list[str]:
    """A list file on the driver; ``-`` is standard input."""
    if path == "-":
        data = sys.stdin.buffer.read()
    else:
        with open(path, "rb") as f:
            data = f.read()
    return parse_list(data.decode("utf-8", "replace"))


def kind_of(pattern: str) -> tuple[str, str]:
    """(kind, key) of a pattern."""
    if "*" in pattern:
        return "glob", pattern
    if pattern.startswith("@"):
        return "domain", pattern[1:]
    return ("exact" if "@" in pattern else "domain"), pattern


def compile_patterns(given: Iterable[str], files: Iterable[str] = ()) -> list[tuple[int, str, str, str]]:
    """(idx, pattern, kind, key) in order, each pattern once: those given first, then those of the files."""
    texts = [p for line in given for p in parse_list_line(line)]
    texts += [p for path in files for p in read_list(path)]
    return [(i, p, *kind_of(p)) for i, p in enumerate(dict.fromkeys(texts))]


def patterns_df(spark: SparkSession, patterns: Sequence[tuple[int, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(patterns), "idx int, pattern string, kind string, key string")


def match(senders: DataFrame, patterns: DataFrame) -> DataFrame:
    """``sender`` -> ``sender, idx`` for the senders that match: exact before domain before glob, and the
    first pattern of its kind."""
    small = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    hint = F.broadcast if small else (lambda df: df)
    who = senders.where("sender <> ''").select("sender").distinct()

    def of(kind: str) -> DataFrame:
        return hint(patterns.where(F.col("kind") == kind).select("key", "idx"))

    exact = who.join(of("exact"), F.col("sender") == F.col("key")).select("sender", F.lit(0).alias("rank"), "idx")
    suffixes = who.select("sender", F.explode(domain_suffixes(domain_of(F.col("sender")))).alias("suffix"))
    domain = suffixes.join(of("domain"), F.col("suffix") == F.col("key")).select("sender", F.lit(1).alias("rank"), "idx")
    globs = of("glob").withColumn("like", glob_like(F.col("key")))
    glob = who.join(globs, F.expr("sender LIKE like")).select("sender", F.lit(2).alias("rank"), "idx")
    best = exact.union(domain).union(glob).groupBy("sender").agg(F.min(F.struct("rank", "idx")).alias("m"))
    return best.select("sender", "m.idx")


class Matcher:
    """A pattern list as hash tables: exact before domain before glob, and the first pattern of its kind."""

    def __init__(self, patterns: Sequence[tuple[int, str, str, str]]) -> None:
        self.exact: dict[str, int] = {}
        self.domain: dict[str, int] = {}
        self.globs: list[tuple[int, re.Pattern[str]]] = []
        for idx, _, kind, key in patterns:
            if kind == "glob":
                self.globs.append((idx, re.compile(".*".join(map(re.escape, key.split("*"))), re.S)))
            else:
                (self.exact if kind == "exact" else self.domain).setdefault(key, idx)

    def __call__(self, sender: str | None) -> int | None:
        if not sender:
            return None
        if (idx := self.exact.get(sender)) is not None:
            return idx
        found, suffix = [], sender.rpartition("@")[2]
        while self.domain:
            if (idx := self.domain.get(suffix)) is not None:
                found.append(idx)
            _, dot, suffix = suffix.partition(".")
            if not dot:
                break
        if found:
            return min(found)
        return next((idx for idx, glob in self.globs if glob.fullmatch(sender)), None)


Patterns = Sequence[tuple[int, str, str, str]]


def matched(sender: Column, *lists: Patterns) -> Column:
    """Per list the index of the pattern that ``sender`` matches, or null, as fields ``_0, _1, ...`` of a struct: decided
    row by row without a join, all lists at once."""
    given, names = [list(patterns) for patterns in lists], [f"_{i}" for i in range(len(lists))]
    kind = "struct<" + ",".join(f"{name}:int" for name in names) + ">"
    if not any(given):
        return F.lit(None).cast(kind)

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matchers = [Matcher(patterns) for patterns in given]
        for senders in batches:
            coded = senders.dictionary_encode()
            texts = coded.dictionary.to_pylist()
            found = [pa.array(map(matcher, texts), pa.int32()).take(coded.indices) for matcher in matchers]
            yield pa.StructArray.from_arrays(found, names)

    return find(sender)


@dataclass
class Rules:
    """What to drop, and whom never to drop."""

    drop: Sequence[tuple[int, str, str, str]] = ()
    keep: Sequence[tuple[int, str, str, str]] = ()
    labels: Sequence[str] = ()
    bulk: bool = False

    def __bool__(self) -> bool:
        return bool(self.drop or self.labels or self.bulk)


@dataclass
class Options:
    """Options of a reduction run beside its rules."""

    strip: bool = False
    extract: bool = False
    min_attachment_kb: int = 0
    tool_name: str = "postern"


def classify(msgs: DataFrame, rules: Rules) -> DataFrame:
    """``msgs`` plus ``reason`` (``label``, ``bulk``, ``sender`` or null) and ``rule_idx``.

    One reason per message, in that order; a protected sender has none."""
    found = matched(F.col("sender"), rules.keep, rules.drop)
    rows = msgs.withColumn("__keep", found["_0"]).withColumn("__drop", found["_1"])
    wanted = F.array(*[F.lit(label.translate(_ASCII_LOWER)) for label in rules.labels]).cast("array<string>")
    labelled = F.arrays_overlap(F.transform("labels", ascii_lower), wanted)
    reason = (
        F.when(F.col("__keep").isNotNull(), None)
        .when(F.coalesce(labelled, F.lit(False)), "label")
        .when(F.lit(rules.bulk) & F.col("bulk"), "bulk")
        .when(F.col("__drop").isNotNull(), "sender")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("rule_idx", F.when(F.col("reason") == "sender", F.col("__drop"))).drop("__keep", "__drop")


def dropped_by_reason(classified: DataFrame) -> DataFrame:
    return classified.where("reason IS NOT NULL").groupBy("reason").agg(
        F.count(F.lit(1)).alias("msgs"), F.sum("size").cast("long").alias("bytes")
    )


def dropped_senders(classified: DataFrame) -> DataFrame:
    return classified.where("reason IS NOT NULL").groupBy(F.coalesce("sender", F.lit("")).alias("sender")).agg(
        F.count(F.lit(1)).alias("msgs"), F.sum("size").cast("long").alias("bytes")
    )


def rule_hits(classified: DataFrame, patterns: Sequence[tuple[int, str, str, str]]) -> DataFrame:
    """``idx, pattern, msgs, bytes`` of every drop pattern, also of those that matched nothing."""
    hits = classified.where("reason = 'sender'").groupBy(F.col("rule_idx").alias("idx")).agg(
        F.count(F.lit(1)).alias("msgs"), F.sum("size").cast("long").alias("bytes")
    )
    rows = patterns_df(classified.sparkSession, patterns).join(hits, "idx", "left")
    zero = F.lit(0).cast("long")
    return rows.select("idx", "pattern", F.coalesce("msgs", zero).alias("msgs"), F.coalesce("bytes", zero).alias("bytes"))

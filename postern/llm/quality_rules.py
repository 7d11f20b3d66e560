"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; policies are named, versioned masks over those bits, so a new policy or an ablation
needs no second look at the texts. Ablations aggregate over the distinct bitmasks, of which there
are at most ``2 ** len(RULES)`` whatever the corpus size.

Defined cases: a null text counts as empty (zero words, so ``few_words`` fails); a null or repeated
``doc_id`` is one ledger row per input row; extra input columns are ignored; an empty table gives
an empty ledger. Windows are compared by a 64-bit hash of their eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import words

WINDOW = 8

#: Bit position of each rule; append only, so that stored ledgers stay readable.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 60 * word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
}

#: Versioned policies: the rules a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
    "v1-no-case": tuple(r for r in RULES if r != "upper_case"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: the id and every measurement, each text read once.

    With ``carry`` the input row comes along as the struct ``__row``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    along = ["doc_id", *(["__row"] if carry else [])]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *row, text.alias("__t"))
    df = df.select(
        *along,
        words(F.col("__t")).alias("__w"),
        F.expr("filter(split(__t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("__lines"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
    )
    df = df.select(
        *along,
        "n_symbols",
        "n_upper",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size(__w) > {WINDOW} THEN transform(sequence(1, size(__w) - {WINDOW - 1}),"
            f" i -> xxhash64(slice(__w, i, {WINDOW}))) END"
        ).alias("__win"),
    )
    # Only texts in which some window occurs twice pay for the sort that locates them.
    df = df.withColumn(
        "__pairs",
        F.expr(
            "CASE WHEN size(array_distinct(__win)) < size(__win)"
            " THEN array_sort(transform(__win, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        "__at",
        F.expr(
            "array_sort(transform(filter(__pairs, (x, i) -> coalesce(get(__pairs, i - 1).h = x.h, false)"
            " OR coalesce(get(__pairs, i + 1).h = x.h, false)), x -> x.i))"
        ),
    )
    covered = F.expr(
        f"aggregate(__at, named_struct('last', -{WINDOW}, 'n', 0L),"
        f" (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(*along, *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The measurements plus ``fail_bits``: bit i is set where rule i of ``RULES`` fails."""
    bits = F.lit(0).cast("long")
    for rule, test in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return measured(docs, id_col, text_col, carry).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """``led`` plus ``base_failed`` and ``kept`` under a named policy."""
    base_failed = ~passes("base")
    return led.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & passes(policy))


def kept_rows(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns."""
    # A filter on the bits would be pushed down through every projection, which writes each measurement's
    # expression out again wherever it is used, and the planner would not come to an end. It does not push
    # filters through a projection that numbers its rows.
    led = ledger(docs, id_col, text_col, carry=True).withColumn("__at", F.monotonically_increasing_id())
    return led.where((F.col("__at") >= 0) & passes("base") & passes(policy)).select("__row.*")


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that would come back without it."""
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).count()
    rules = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    )
    each = counts.select("bits", "count", rules.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("count")).otherwise(0)).alias("n_only"),
    )

"""Chat formatting by prefix-target expansion (DataFrame functions only).

Each assistant turn becomes its own example: all preceding turns as context, and only that reply
trainable. A conversation whose last turn is not the assistant's gets one more example without a
target, so that every turn can be read back.

Template, per turn: ``<turn ROLE>\\nTEXT</turn>\\n``. Inside roles and texts ``\\``, ``<`` and ``>``
are written ``\\b``, ``\\l`` and ``\\g``; the marks therefore never occur inside a text, and
unescaping ``\\l``, ``\\g``, ``\\b`` in that order restores it exactly.

Defined cases: null texts and null roles count as empty; turns are ordered by (turn, role, text), null
turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation;
extra columns are ignored; an empty table gives no examples. Prefixes are cut from one string per
conversation, example by example, so memory follows the longest conversation, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def examples(convs: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example`` (its turn), ``formatted, loss_start`` (0-based code
    point), ``loss_chars`` (0 without a target), ``trainable, is_last``."""
    rows = convs.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    rows = rows.withColumn("piece", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"), body, F.lit(CLOSE)))
    rows = rows.withColumn("body_chars", F.length(body).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.lead("role").over(order).isNull().alias("is_last"),
        (F.col("role") == ASSISTANT).alias("trainable"),
        "body_chars",
        "piece",
    )
    # Same partitioning and order as the window: no second exchange.
    turn = F.struct("at", "end", "is_last", "trainable", "body_chars", "piece")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.expr("transform(turns, t -> t.piece)"), "").alias("whole"),
        F.expr(
            "transform(filter(turns, t -> t.trainable OR t.is_last), t -> named_struct('at', t.at, 'end', t.end,"
            " 'is_last', t.is_last, 'trainable', t.trainable, 'body_chars', t.body_chars))"
        ).alias("targets"),
    )
    each = whole.select("conv_id", "whole", F.explode("targets").alias("t"))
    end = F.col("t.end").cast("int")
    return each.select(
        "conv_id",
        F.col("t.at").alias("example"),
        F.substring(F.col("whole"), F.lit(1), end).alias("formatted"),
        F.when(F.col("t.trainable"), F.col("t.end") - len(CLOSE) - F.col("t.body_chars"))
        .otherwise(F.col("t.end"))
        .alias("loss_start"),
        F.when(F.col("t.trainable"), F.col("t.body_chars")).otherwise(F.lit(0)).alias("loss_chars"),
        F.col("t.trainable").alias("trainable"),
        F.col("t.is_last").alias("is_last"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns (longest example) and its loss text."""
    loss = unescape(
        F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    )
    got = made.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("formatted"))).alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("example", loss.alias("loss"))))).alias("parts"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    pattern = "(?s)<turn ([^>]*)>\\n([^<]*)</turn>\\n"
    got = got.select(
        "conv_id",
        "formatted_chars",
        F.array_join(F.expr("transform(parts, p -> p.loss)"), "").alias("loss_text"),
        F.regexp_extract_all("longest", F.lit(pattern), F.lit(1)).alias("roles"),
        F.regexp_extract_all("longest", F.lit(pattern), F.lit(2)).alias("texts"),
    )
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        unescape(turns).alias("turns_text"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        "loss_text",
        "formatted_chars",
    )

"""Column expressions on words: maximal runs of ``[^\\x20\\x09-\\x0D]``, whole texts, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPLIT))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")

"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources get a share of all words by weight, never more than ``cap`` times their own size; the excess
is shared again by weight. The fixed point has a closed form: with sources sorted by
``cap * size / weight``, those below a level are capped and the rest get ``level * weight``.

Inside a source every document expects ``target / source_size`` copies. The running sum of expected
copies plus one random offset is cut at the integers: a document is emitted once per integer that
its interval crosses. Documents are summed in order of (size, doc_id), which spreads the copies over
all lengths, so the words taken differ from the target by a few documents at most.

Defined cases: null texts have size 0; sources sort by code point with null last; a source of size 0
has target 0 and emits nothing; null and repeated ids are rows of their own (ties in the order have
equal sizes, so which of them is taken does not change the words); an empty table gives an empty mix.
Offsets depend on the seed and the source only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rank import BROADCAST_ROWS, ranked
from ._store import written
from ._words import n_words

WEIGHTS = (1, 2, 3)
CAP = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` -> plus ``target``; one row per source in and out."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(rank) - 1, len(weights)) + 1)
    df = sizes.withColumn("weight", weight).withColumn("level", cap * F.col("source_size") / F.col("weight"))
    below = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    df = (
        df.withColumn("size_below", F.coalesce(F.sum("source_size").over(below), F.lit(0)))
        .withColumn("weight_below", F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("size_all", F.sum("source_size").over(everything))
        .withColumn("weight_all", F.sum("weight").over(everything))
    )
    # The level at which everything is shared if exactly the sources below this one are capped.
    shared = (F.col("size_all") - cap * F.col("size_below")) / (F.col("weight_all") - F.col("weight_below"))
    df = df.withColumn("own_level", shared)
    fits = F.when(F.col("own_level") <= F.col("level"), F.col("own_level"))
    df = df.withColumn("final_level", F.max(fits).over(everything))
    target = F.least(cap * F.col("source_size").cast("double"), F.col("final_level") * F.col("weight"))
    return df.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """In [0, 1), from the first 32 bits of a digest of the seed and the source."""
    named = F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed}"))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 7, carry: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    With ``carry`` the whole input row comes along as the struct ``__row``."""
    cols = [F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = ranked(docs.select(*cols), "source", ["size", "doc_id"], "rank", "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = written(targets(sizes, weights, cap), "mix-targets").withColumnRenamed("source", "__source")
    if shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shares = F.broadcast(shares)
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.floor(rate * (F.col("rank") + 1) + _offset(F.col("source"), seed))
    before = F.floor(rate * F.col("rank") + _offset(F.col("source"), seed))
    copies = F.least((upto - before).cast("long"), F.ceil(rate).cast("long"))
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("rank")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The mixed corpus: each document's row once per copy, with the columns of ``docs``."""
    rows = mixed(docs, weights, cap, seed, carry=True).where("copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")

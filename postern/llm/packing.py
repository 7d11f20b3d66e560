"""Packing by optimal length buckets.

A dynamic program over the global length histogram chooses the bucket boundaries that minimise
padding; inside each bucket, documents in order of length form batches under a token budget.

The histogram has a cell for every length that occurs, so the boundaries are optimal for the corpus. It goes
to the driver: its size is that of the set of different lengths, at most the number of words of the longest
document, whatever the number of documents. Lengths are words unless the caller gives another length (such as
the token counts of ``token_counts``), and the budget counts the same. A document longer than the budget is a batch
of its own; nothing is cut.

Defined cases: a null text has length 0; null and repeated ids are rows of their own; ties in length
go by id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rank import ranked
from ._words import n_words

BUCKETS = 16
BUDGET = 8192


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(length, rows, sum of lengths) per length, ascending."""
    rows = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r.length, r.n, r.length * r.n) for r in rows.collect())


def boundaries(cells: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Ascending upper boundaries, at most ``buckets``, with the least padding over all choices of
    cell tops. ``cost(j, i) = top[i] * rows(j..i) - words(j..i)`` fulfils the quadrangle inequality,
    so each layer is solved by divide and conquer."""
    if not cells:
        return []
    top = np.array([c[0] for c in cells], np.float64)
    rows = np.concatenate([[0.0], np.cumsum([c[1] for c in cells], dtype=np.float64)])
    best = top * rows[1:]  # one bucket; the sum of lengths is the same for every choice
    choice = []
    for _ in range(min(buckets, len(cells)) - 1):
        following, cut = np.empty_like(best), np.zeros(len(cells), np.int64)
        todo = [(0, len(cells) - 1, 0, len(cells) - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            mid = (lo + hi) // 2
            # bucket (j, mid] for j in first..mid-1, or everything up to mid in one bucket
            j = np.arange(first, min(mid - 1, last) + 1)
            costs = best[j] + top[mid] * (rows[mid + 1] - rows[j + 1])
            k = int(costs.argmin()) if len(j) else -1
            if k >= 0 and costs[k] < top[mid] * rows[mid + 1]:
                following[mid], cut[mid] = costs[k], j[k]
            else:
                following[mid], cut[mid] = top[mid] * rows[mid + 1], -1
            at = int(j[k]) if k >= 0 else first
            if lo < mid:
                todo.append((lo, mid - 1, first, at))
            if mid < hi:
                todo.append((mid + 1, hi, at, last))
        best, choice = following, [*choice, cut]
    out, i = [int(top[-1])], len(cells) - 1
    for cut in reversed(choice):
        i = int(cut[i])
        if i < 0:
            break
        out.append(int(top[i]))
    return out[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, length, bucket, boundary, batch_id, slot``.

    A batch holds ``max(1, budget // boundary)`` documents, each padded to the bucket's boundary."""
    length = n_words(F.col("text")) if length is None else length
    lengths = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    bounds = boundaries(histogram(lengths), buckets) or [0]
    uppers = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(uppers, lambda b: b < F.col("length")))
    rows = ranked(lengths.withColumn("bucket", bucket), "bucket", ["length", "doc_id"], "rank", "pack")
    rows = rows.withColumn("boundary", F.get(uppers, F.col("bucket")))
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return rows.select(
        "doc_id",
        "length",
        "bucket",
        "boundary",
        F.concat_ws("-", F.col("bucket"), F.floor(F.col("rank") / per_batch)).alias("batch_id"),
        (F.col("rank") % per_batch).cast("long").alias("slot"),
    )

"""Connected components of an edge table, on the executors.

Every round rewrites the edges by a large-star and a small-star step until each node points to the least
node of its component; rounds grow with the logarithm of the longest path. Before that, each task
replaces the edges it happens to hold by a spanning star per local component. Once no more than
``LOCAL`` edges are left, one task solves them at once; larger graphs never meet in one task. Rounds are
cut by written tables, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

#: Edges one task holds at once (about 100 bytes each).
LOCAL = 500_000
ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) -> (node, least node of its component), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        lu, lv = label[u], label[v]
        lo, hi = np.minimum(lu, lv), np.maximum(lu, lv)
        if (lo == hi).all():
            break
        np.minimum.at(label, hi, lo)
        while not ((up := label[label]) == label).all():
            label = up
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def solved() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        node, root = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > LOCAL:
            held = [solved()]
            if held[0].num_rows > LOCAL // 2:
                yield held[0]
                held = []
    if held:
        yield solved()


def _starred(edges: DataFrame) -> DataFrame:
    return written(edges.select("a", "b").mapInArrow(_stars, "a bigint, b bigint"), "edges")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """``a, b`` (different longs) -> ``node, root`` for every node that has an edge and is not its root;
    root is the least node that it reaches."""
    now = _starred(edges)
    for _ in range(ROUNDS):
        if now.limit(local + 1).count() <= local:
            return _starred(now.coalesce(1)).toDF("node", "root")
        # Large star: the larger neighbours of a node point to the least of it and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        # Small star: a node and its smaller neighbours point to the least of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = _starred(low.toDF("a", "b").union(rest).distinct())
        now = written(now.distinct(), "edges")
        forked = now.groupBy("a").count().where("count > 1").limit(1).count()
        chained = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if not forked and not chained:
            return now.toDF("node", "root")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")

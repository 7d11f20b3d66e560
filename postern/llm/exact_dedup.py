"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts (by a prefix of their bytes, then their digest,
then the identifier, so that splitters stay small and a text with very many copies is spread over
many tasks). Spark's external sort places equal texts next to each other; neighbours are compared in
full. Runs that reach a partition's edge are joined to their neighbours through a table with the first and the
last row of every partition: one task sees their digests, and where those are equal a join compares the texts in full.

Defined cases: a null text counts as empty; null identifiers sort below all others, and a group of
only null identifiers has a null ``keep_id``; exactly one row of each group has ``kept``, also when an
identifier repeats; extra columns travel with their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rank import BROADCAST_ROWS
from ._store import written

PREFIX = 64


def _scan(carry: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the runs of equal neighbours in a sorted partition; mark its first and last row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        run, last_text, held = -1, None, None

        def out(batch: pa.RecordBatch, runs: np.ndarray, heads: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
            n = batch.num_rows
            edge = np.zeros(n, np.int32)
            edge[0] += 1 * first
            edge[-1] += 2 * last
            text = batch.column("text")
            cols = {
                "doc_id": batch.column("doc_id"),
                "text_sha256": batch.column("text_sha256"),
                "run": pa.array(part + runs, pa.int64()),
                "head": pa.array(heads),
                "edge": pa.array(edge),
                "edge_text": pc.if_else(pa.array(edge > 0), text, pa.scalar(None, text.type)),
            }
            if carry:
                cols["__row"] = batch.column("__row")
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column("text")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last_text is None or text[0].as_py() != last_text
            runs = run + np.cumsum(new)
            run, last_text = int(runs[-1]), text[-1].as_py()
            if held is not None:
                yield out(*held, first, False)
                first = False
            held = (batch, runs, new)
        if held is not None:
            yield out(*held, first, True)

    return scan


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "max",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` chooses the row that stays: ``min`` or ``max`` identifier. With ``carry`` the input row
    comes along as the struct ``__row``."""
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    spark = docs.sparkSession
    text = F.coalesce(normalise(F.col(f"`{text_col}`")), F.lit(""))
    cols = [F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256")]
    cols.append(F.substring(F.encode(text, "utf-8"), 1, PREFIX).alias("prefix"))
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    by_id = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    order = [F.col("prefix"), F.col("text_sha256"), by_id]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*cols)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(
        F.col("prefix"), F.col("text_sha256"), F.col("text"), by_id
    )
    rows = rows.drop("prefix")
    schema = (
        rows.select("doc_id", "text_sha256")
        .schema.add("run", T.LongType())
        .add("head", T.BooleanType())
        .add("edge", T.IntegerType())
        .add("edge_text", T.StringType())
    )
    if carry:
        schema = schema.add(rows.schema["__row"])
    scanned = rows.mapInArrow(_scan(carry), schema)
    scanned = written(scanned, "dedup")

    # Runs are local to a partition, so the counts combine before the shuffle.
    best = F.min("doc_id") if keep == "min" else F.max("doc_id")
    runs = scanned.groupBy("run").agg(best.alias("best"), F.count(F.lit(1)).alias("rows"))
    # Two rows per partition at most: does a run go on where the partition before it ended?
    sides = F.expr("CASE edge WHEN 1 THEN array(1) WHEN 2 THEN array(2) ELSE array(1, 2) END")
    edges = scanned.where("edge > 0").select(F.explode(sides).alias("side"), "run", "text_sha256", "edge_text")
    # The one-task window sees digests only; equal ones are then compared in full, wherever their texts lie.
    along = Window.orderBy("run", "side")
    before = [F.lag(c).over(along).alias(f"{c}_before") for c in ("run", "side", "text_sha256")]
    marked = written(edges.select("run", "side", "text_sha256", *before), "dedup-edges")
    alike = marked.where("side = 1 AND text_sha256 = text_sha256_before").select("run", "side", "run_before", "side_before")
    here = edges.select("run", "side", F.col("edge_text").alias("text"))
    there = edges.select(F.col("run").alias("run_before"), F.col("side").alias("side_before"), F.col("edge_text").alias("text_before"))
    equal = alike.join(here, ["run", "side"]).join(there, ["run_before", "side_before"]).where("text = text_before")
    marked = marked.join(equal.select("run", "side", F.lit(True).alias("goes_on")), ["run", "side"], "left")
    goes_on, same_run = F.coalesce("goes_on", F.lit(False)), F.coalesce(F.col("run") == F.col("run_before"), F.lit(False))
    chain = F.sum(F.when(goes_on | same_run, 0).otherwise(1)).over(along)
    chains = marked.select("run", goes_on.alias("goes_on"), chain.alias("chain")).groupBy("run", "chain").agg(F.max("goes_on").alias("goes_on"))
    chains = written(chains, "dedup-chains")
    # Only chains need the totals of several runs; they have as many rows as partitions, twice at most.
    totals = chains.join(runs, "run").groupBy("chain").agg(
        (F.min("best") if keep == "min" else F.max("best")).alias("chain_best"), F.sum("rows").alias("chain_rows")
    )
    fixes = written(chains.join(totals, "chain").drop("chain"), "dedup-fixes")
    runs = written(runs.where("rows > 1"), "dedup-runs")
    if fixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        fixes = F.broadcast(fixes)
    out = scanned.join(fixes, "run", "left").join(runs, "run", "left")
    keep_id = F.coalesce("chain_best", "best", "doc_id")
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("chain_rows", "rows", F.lit(1)).cast("long").alias("group_size"),
        (F.col("head") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"),
        "text_sha256",
        *(["__row"] if carry else []),
    )

"""Global row ranks inside groups without a task per group.

``ranked`` range-partitions on (group, order, ...), so a group that holds a third of all rows is
spread over many tasks. The position of a row inside its sorted partition is read from
``monotonically_increasing_id``; a tiny table of (group, partition) counts then gives each
partition its base rank. Rows cross the network once, and no window runs over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

#: Rows of the (group, partition) table up to which it is broadcast (about 50 bytes each).
BROADCAST_ROWS = 200_000


def ranked(df: DataFrame, group: str, order: list[str], rank: str, name: str) -> DataFrame:
    """``df`` plus ``rank``: the 0-based position of each row in its group by ``order`` (nulls first)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = written(placed, name).withColumn("__part", F.shiftright("__at", 33))
    blocks = placed.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__in")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    before = Window.partitionBy("__group").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(
        blocks.withColumn("__base", F.coalesce(F.sum("__rows").over(before), F.lit(0))), f"{name}-blocks"
    )
    if blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    return (
        placed.join(blocks, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__in")), "left")
        .withColumn(rank, F.col("__at") - F.col("__first") + F.col("__base"))
        .drop("__at", "__part", "__group", "__in", "__first", "__rows", "__base")
    )

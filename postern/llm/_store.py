"""Shared-folder tables: how multi-pass operators cut lineage and survive lost executors.

Everything an operator needs twice is written once as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir`` and read back from there, so no later stage depends
on the memory or the disk of one executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. A local master without one gets a local folder; a cluster must name it."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"postern-shared-{os.getuid()}")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def posix(path: str) -> str | None:
    """The plain path of a ``file:`` URI or a path without a scheme; None for other stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        limit = (int(ends[at - 1]) if at else 0) + size
        upto = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield at, upto
        at = upto

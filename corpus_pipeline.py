"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage reads all that its predecessor kept; all but the last return the columns of ``documents``.
A null text counts as empty and fails the quality rules. ``run`` writes every stage's result to the
shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from postern.llm._store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps; the ledger is computed next to its row, without a join."""
    return quality_rules.kept_rows(docs, "v1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest id."""
    return exact_dedup.dedup(docs, keep="max", carry=True).where("kept").select("__row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document has one row per copy."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its length bucket, batch and slot."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Near duplicates are components of a similarity graph, and packing is an optimisation: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs

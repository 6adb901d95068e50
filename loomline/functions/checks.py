"""Invariants of relations as queries that return the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def not_contiguous(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Groups whose ordinals are not 0..n-1."""
    g = df.groupBy(group).agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.countDistinct(ordinal).alias("n"), F.count("*").alias("rows"))
    return g.where("first <> 0 or last <> n - 1 or rows <> n")


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left = a.select(key).distinct().withColumn("l", F.lit(1))
    right = b.select(key).distinct().withColumn("r", F.lit(1))
    return left.join(right, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "RIGHT").otherwise("LEFT").alias("side"))


def broken(df: DataFrame, code: str, condition) -> DataFrame:
    """Rows for which ``condition`` does not hold, with a code."""
    return df.where(~F.coalesce(condition, F.lit(False))).withColumn("violation_code", F.lit(code))


def require_empty(df: DataFrame, code: str) -> None:
    if not df.isEmpty():
        raise ValueError(code)

"""Folder revisions: compare, count, verify, diff."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import graph

STATUSES = ["ADDED", "MODIFIED", "REMOVED", "UNCHANGED"]


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer diff of two inventories (``relative_path, byte_count, sha256``)."""
    b = before.select("relative_path", F.col("sha256").alias("before_sha256"), F.col("byte_count").alias("before_bytes"))
    a = after.select("relative_path", F.col("sha256").alias("after_sha256"), F.col("byte_count").alias("after_bytes"))
    j = b.join(a, "relative_path", "full_outer")
    status = F.when(F.col("before_sha256").isNull(), "ADDED").when(F.col("after_sha256").isNull(), "REMOVED").when(F.col("before_sha256") == F.col("after_sha256"), "UNCHANGED").otherwise("MODIFIED")
    return j.withColumn("status", status)


def counts(comparison: DataFrame) -> DataFrame:
    """One row with a count for each status, zero included."""
    return comparison.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in STATUSES])


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks (must be empty)."""
    return expected.exceptAll(actual).withColumn("side", F.lit("EXPECTED")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("ACTUAL")))


def _diff(path: str, before: str | None, after: str | None) -> str:
    lines = difflib.unified_diff((before or "").splitlines(keepends=True), (after or "").splitlines(keepends=True), f"before/{path}", f"after/{path}")
    return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in lines)


@F.pandas_udf(StringType())
def unified_diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two whole texts (no built-in exists); a last line without its end is marked."""
    return pd.Series([_diff(*x) for x in zip(path, before, after)])


def diffs(pairs: DataFrame) -> DataFrame:
    """``relative_path, diff`` of the rows ``relative_path, before, after`` whose texts differ, as of ``unified_diff``.

    Texts go through Python some at a time, whatever the size of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 20):
                paths, before, after = (b.column(c).slice(k, 20) for c in ("relative_path", "before", "after"))
                out = [_diff(*x) for x in zip(paths.to_pylist(), before.to_pylist(), after.to_pylist())]
                yield pa.RecordBatch.from_arrays([paths.cast(pa.string()), pa.array(out, pa.string())], names=["relative_path", "diff"])

    graph.modest_batches(pairs.sparkSession)
    changed = pairs.select("relative_path", "before", "after").where("not before <=> after")
    return changed.mapInArrow(run, "relative_path string, diff string").where("diff <> ''")

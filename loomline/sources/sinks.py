"""Sinks: write once, write or verify, append with checks, exactly once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .commits import CommitLog


class Conflict(ValueError):
    """What is stored differs from what was to be stored."""


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def differs(a: DataFrame, b: DataFrame) -> bool:
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def write_or_verify(df: DataFrame, path: str) -> bool:
    """True if written; False if the same rows were there; other rows are an error."""
    try:
        there = df.sparkSession.read.schema(df.schema).parquet(path)
        there.isEmpty()
    except AnalysisException:
        write_once(df, path)
        return True
    if differs(df, there):
        raise Conflict(path)
    return False


def append_dense(df: DataFrame, path: str, key: str = "job_id", order: str = "sequence", every: int = 20) -> None:
    """Commit events whose sequence goes on without a gap from what is stored, as JSON lines; many may write at once.

    A commit is checked against the last number of each key as of the version before it: the
    kept copy of those numbers (at each ``every``-th version) and the commits since.
    """
    log = CommitLog(df.sparkSession, path, df.schema, "json")
    fold = lambda rows: rows.groupBy(key).agg(F.max(order).alias("last"))
    merge = lambda a, b: a.unionByName(b).groupBy(key).agg(F.max("last").alias("last"))

    def check(view) -> DataFrame:
        w = Window.partitionBy(key).orderBy(order)
        want = F.coalesce("last", F.lit(0)) + F.row_number().over(w)
        if not df.join(view.state(fold, merge), key, "left").withColumn("want", want).where(F.col(order) != F.col("want")).isEmpty():
            raise Conflict("sequence")
        return df

    view = log.commit(check)
    log.keep_state(view, view.state(fold, merge), every)


def journal(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events that ``append_dense`` committed."""
    return CommitLog(spark, path, schema, "json").now().rows()


def once_per_key(target: str, key: str, buckets: int = 256):
    """A ``foreachBatch`` function that stores each key at most once, also when a batch runs again.

    Keys are dealt to ``buckets`` folders by hash; a batch reads the key column of the folders
    that its own keys fall into, and of batches before it, no more.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        mine = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        try:
            there = spark.read.parquet(target).where(F.col("bucket").isin(mine) & (F.col("batch_id") < batch_id)).select(key)
            new = new.join(there, key, "left_anti")
        except AnalysisException:
            pass
        new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(target)

    return store


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A small report as a Markdown table (rows in column order)."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    return "\n".join(head + [r[0] for r in df.orderBy(*columns).select(cells).collect()]) + "\n"

"""Measures of ranked results against graded judgements, by query and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place.cast("double") + 1)


def per_query(results: DataFrame, judged: DataFrame, allowed: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``query_id, relevant, found, recall, reciprocal_rank, ndcg, returned, leaked`` of every query with results or judgements.

    ``results``: ``query_id, item_id, rank`` from 1; ``judged``: ``query_id, item_id, grade`` (0: not
    relevant; the highest counts if a pair is judged twice).  Of results that name an item
    twice the better rank counts.  ``allowed``: pairs ``query_id, item_id`` that may be returned;
    what is not there and is returned has leaked.  ``recall`` and ``ndcg`` are null where
    nothing is relevant.  The ideal order of a query is made of its judgements by grade, whose
    places follow from how many have each grade, so no window holds a query's judgements.
    """
    top = results.where(F.col("rank") <= k).groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    grades = judged.groupBy("query_id", "item_id").agg(F.max("grade").alias("grade"))
    j = top.join(grades, ["query_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    if allowed is not None:
        j = j.join(allowed.select("query_id", "item_id", F.lit(True).alias("may")).distinct(), ["query_id", "item_id"], "left")
    leaked = F.count(F.when(F.col("may").isNull(), 1)) if allowed is not None else F.lit(0).cast("long")
    hit = F.col("grade") > 0
    got = j.groupBy("query_id").agg(F.count("*").alias("returned"), leaked.alias("leaked"), F.count(F.when(hit, 1)).alias("found"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    n = grades.where("grade > 0").groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    steps = n.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("g"), F.sum("n").alias("relevant"))  # an entry a grade
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("sum"))

    def add(s: Column, x: Column) -> Column:
        end = F.least(s["at"] + x["n"], F.lit(k))
        places = F.when(end > s["at"], F.sequence(s["at"] + 1, end)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(end.cast("long").alias("at"), (s["sum"] + F.aggregate(places, F.lit(0.0), lambda a, p: a + _gain(x["grade"], p))).alias("sum"))

    ideal = steps.select("query_id", "relevant", F.aggregate("g", start, add)["sum"].alias("ideal"))
    q = got.join(ideal, "query_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.when(zero(b) > 0, zero(a) / F.col(b))
    return q.select(
        "query_id",
        zero("relevant").cast("long").alias("relevant"),
        zero("found").cast("long").alias("found"),
        share("found", "relevant").alias("recall"),
        F.when(F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(0.0).alias("reciprocal_rank"),
        share("dcg", "ideal").alias("ndcg"),
        zero("returned").cast("long").alias("returned"),
        zero("leaked").cast("long").alias("leaked"),
    )


def overall(queries: DataFrame, *group: str) -> DataFrame:
    """Means over queries with something relevant, and the share of leaked among all results."""
    some = F.col("relevant") > 0
    mean = lambda c: F.avg(F.when(some, F.col(c)))
    leakage = F.when(F.sum("returned") > 0, F.sum("leaked") / F.sum("returned"))
    return queries.groupBy(*group).agg(F.count(F.when(some, 1)).alias("queries"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"), leakage.alias("leakage"))

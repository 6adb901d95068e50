"""Duplicate clusters without drift: every member is within the threshold of its cluster's canonical member.

Components of links chain: a may be like b, and b like c, while a and c are far apart.  Here an
item is canonical exactly if no item before it (by ``rank``, then id) that is canonical is linked
with it, and every other item belongs to a canonical one that it is linked with itself, the most
similar one.  This is what going through the items in order gives; it is found in rounds, in
each of which all items decide that no undecided item before them is linked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .similarity import Similar


def canonical(items: DataFrame, links: DataFrame) -> DataFrame:
    """``id, canonical_id, similarity`` of ``items`` (``id, rank``; ids unique) under ``links`` (``a, b, similarity``).

    A canonical item is its own, with similarity 1.  Links between unknown items, loops and
    repeated links do no harm.  A chain of links in rank order takes a round for every other
    item; ranks that are independent of the links take about the logarithm of their number.
    """
    place = F.struct("rank", "id")
    at = lambda c: items.select(F.col("id").alias(c), place.alias(f"place_{c}"))
    known = links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    both = known.join(at("a"), "a").join(at("b"), "b")
    first = F.col("place_a") < F.col("place_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    edges = graph.cut(both.select(pick("a", "b").alias("head"), pick("b", "a").alias("id")))  # head comes before id
    linked = edges.select("id").union(edges.select("head")).distinct()
    heads, open_ = graph.cut(items.select("id").distinct().join(linked, "id", "left_anti")), graph.cut(linked)
    while not open_.isEmpty():
        # Whom nobody undecided comes before is canonical; whoever is linked with one is decided, too.
        new = graph.cut(open_.join(edges.select("id").distinct(), "id", "left_anti"))
        gone = graph.cut(edges.join(new.withColumnRenamed("id", "head"), "head", "left_semi").select("id").distinct())
        heads = heads.unionByName(new)
        done = new.unionByName(gone)
        still = graph.cut(open_.join(done, "id", "left_anti"))
        rest = graph.cut(edges.join(done.withColumnRenamed("id", "head"), "head", "left_anti").join(gone, "id", "left_anti"))
        graph.forget(open_, edges, gone)
        open_, edges = still, rest
    heads = graph.cut(heads)
    ends = known.select(F.col("a").alias("id"), F.col("b").alias("head"), "similarity").unionByName(known.select(F.col("b").alias("id"), F.col("a").alias("head"), "similarity"))
    best = ends.join(heads.select(F.col("id").alias("head")), "head").groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("head").alias("head"))).alias("best"))
    mine = items.select("id").join(heads.withColumn("is_head", F.lit(True)), "id", "left").join(best, "id", "left")
    own = F.coalesce("is_head", F.lit(False))
    return mine.select("id", F.when(own, F.col("id")).otherwise(F.col("best.head")).alias("canonical_id"), F.when(own, 1.0).otherwise(-F.col("best.s")).alias("similarity"))


def without_drift(similar: Similar, ranks: DataFrame) -> DataFrame:
    """``id, canonical_id, similarity`` of all items of a similarity join: equal sets stay together, in the class of least rank.

    ``ranks``: ``class_id, rank``.
    """
    c = canonical(ranks.select(F.col("class_id").alias("id"), "rank"), similar.links)
    c = c.select(F.col("id").alias("class_id"), "canonical_id", "similarity")
    return similar.members.join(c, "class_id").select("id", "canonical_id", "similarity")

"""Links and groups without pairs of everything.

Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step takes minima (combined before the shuffle) and one join that Spark may split, so a
node with very many links does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    j = both.join(low, "u")
    out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` of every node of ``edges`` (long ``a``, ``b``) that is not its own root.

    The root is the least node of the component.  Loops and repeated edges do no harm; no
    edges give no rows.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = lambda: tuple(e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())
    mark = stamp()
    for _ in range(rounds):
        if mark[0]:
            e = settle(_star(_star(e, True), False))
        now = stamp() if mark[0] else mark
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels ``cid, label`` after the links ``a, b`` (a settled table)."""
    if links.isEmpty():
        return labels
    side = lambda c: labels.select(F.col("cid").alias(c), F.col("label").alias(f"l{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = components(edges).withColumnRenamed("node", "label")
    return settle(labels.join(moved, "label", "left").select("cid", F.coalesce("root", "label").alias("label")))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose ends have different labels."""
    j = pairs.join(labels.select(F.col("cid").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("cid").alias("b"), F.col("label").alias("lb")), "b")
    return j.where("la <> lb").drop("la", "lb")


def _mixed(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the bands that hold more than one label, with their labels (a settled table).

    A class meets its label once, not in each of its bands: their number is that of its own keys.
    """
    own = [c for c in bands.columns if c != "cid"]
    packed = bands.groupBy("cid").agg(F.collect_list(F.struct(*own)).alias("rows"))
    mine = packed.join(labels, "cid").select("cid", "label", F.inline("rows")).select(*bands.columns, "label")
    mixed = mine.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return settle(mine.join(mixed, "key"))


def _led(mine: DataFrame, turn: int, near: Column) -> DataFrame:
    """At most one pair for each class: with the least of its bands' leaders that has another label.

    A band's leader is one combined minimum: its member with the least share of its own, and in
    later turns by another hash each.
    """
    place = (F.col("own") / F.col("n")) if not turn else F.lit(0.0)
    lead = mine.groupBy("key").agg(F.min(F.struct(place.alias("o"), F.xxhash64(F.lit(turn), "cid").alias("h"), F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("own").alias("pown"), F.col("label").alias("pl"))).alias("lead"))
    led = mine.join(lead, "key").select("*", "lead.p", "lead.pn", "lead.pown", "lead.pl").where((F.col("label") != F.col("pl")) & near)
    best = led.groupBy("cid").agg(F.min(F.struct("lead.o", "lead.h", "p")).alias("b"))
    return best.select(F.least("cid", "b.p").alias("a"), F.greatest("cid", "b.p").alias("b")).distinct()


def search_bands(bands: DataFrame, labels: DataFrame, near: Column, compare: Callable[[DataFrame, DataFrame], DataFrame], refine: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, turns: int = 1, few_bands: bool = False) -> DataFrame:
    """Labels after every needed comparison within bands.

    ``bands``: ``key, cid, n, own`` (size, and how much of it no other candidate has).  First,
    for ``turns`` rounds, each class meets one leader of its bands alone: that links nearly
    all members of a large group of copies for one comparison each, however many bands they
    share.  Bands that hold one label rest.  What is left is searched whole: each pivot is
    compared with all of its band that have another label yet (and satisfy ``near`` of ``n,
    own`` and the pivot's ``pn, pown``) and is then done with; those with the least share of
    their own come first.  Later rounds take 32 times as many pivots.  No pair of a band is
    given up.  ``compare`` takes distinct pairs ``a, b`` (a plan, to be run once) and the labels
    and returns the labels after the true links.  From
    the second whole round on, ``refine`` may raise ``own`` in the bands that are left, and
    gives the pairs that this would wrongly leave out.

    ``few_bands`` says that a class is in a bounded number of bands: a row then names them all,
    and a pair is made only in the first band that both its ends are still in.
    """
    for turn in range(turns):
        bands = _mixed(bands, labels)
        if bands.isEmpty():
            return labels
        pairs = _led(bands, turn, near)
        bands = bands.drop("label")
        labels = compare(pairs, labels)
    pivots = 2
    while True:
        mine = _mixed(bands, labels)
        if mine.isEmpty():
            return labels
        more = None
        if refine is not None and pivots > 2:
            mine, more = refine(mine)
        order = Window.partitionBy("key").orderBy(F.col("own") / F.col("n"), F.xxhash64("cid"), "cid")
        chosen = mine.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
        chosen = settle(chosen.select("key", F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("own").alias("pown"), F.col("label").alias("pl")))
        met = (F.col("label") != F.col("pl")) & near
        if few_bands:
            named = mine.groupBy("cid").agg(F.sort_array(F.collect_set("key")).alias("bands"))
            once = F.col("key") == F.array_min(F.array_intersect("bands", "pbands"))
            pairs = mine.join(named, "cid").join(chosen.join(named.select(F.col("cid").alias("p"), F.col("bands").alias("pbands")), "p"), "key").where(met & once)
        else:
            pairs = mine.join(chosen, "key").where(met)
        pairs = pairs.select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"))
        labels = compare((pairs if more is None else pairs.unionByName(more)).distinct(), labels)
        bands = mine.drop("label").join(chosen.select("key", F.col("p").alias("cid")), ["key", "cid"], "left_anti")
        pivots *= 32

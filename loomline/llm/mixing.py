"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Native DataFrame expressions only.

1. Sizes: words of each text.  Targets share all words by source weight; a target stops at
   ``max_epochs`` times its source's size and the excess is shared again (water level).
2. Each source's rows are laid out in a random order (a hash of row and seed) and cut into
   blocks of ``block_words`` words; its quota is the first blocks of up to ``max_epochs``
   passes over that order, its last block cut so that the quota equals the rounded target.
3. A tree splits the block quotas of all sources between two halves of the output shards,
   again and again.  The number of a source's blocks that go left is drawn from the exact
   multivariate hypergeometric law, source by source, by inversion.  Each node keeps for
   each source where its disjoint run of permuted blocks starts.
4. A leaf is one shard: it draws its runs of each source's permuted blocks (so that passes
   mix) and orders them by a hash.  All results are read off the leaves.

Hot sources are spread: prefix sums run in buckets of a few thousand rows of a source.  A
tree node is one row with some 24 bytes a source, so sources are to be some ten thousands at most.

Null text has size 0; a null source is a source of its own, last in weight order.  Sources
without words take nothing.  Repeated rows are separate rows, and ties in the random order
go by id, size and row.  A very long text may span many blocks and shards.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, small_join

U63 = float(1 << 62)


def _key(source: Column) -> Column:
    """A non-null key for a source: null sorts last."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def targets(sources: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """Add ``target`` to rows of ``src`` and ``source_size`` (one row a source).

    One window over the sources, not over rows: they are few by nature.
    """
    total = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("src")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    # Sorted by cap / weight, the first k sources are capped and the rest share what is left.
    by = Window.orderBy(F.col("cap") / F.col("w"), "src")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    free = by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(free))
    fits = F.col("level") * F.col("w") <= F.col("cap") * (1 + 1e-12)
    first_free = F.min(F.when(fits, F.struct((F.col("cap") / F.col("w")).alias("ratio"), "src", "level"))).over(total)
    s = s.withColumn("water", first_free["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.col("water") * F.col("w"))).select("src", "source_size", "n_rows", "target")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, taken back to n; exact to about 1e-13."""
    m = n + F.lit(10.0)
    far = (m + 0.5) * F.ln(m) - m + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * m) - 1 / (360 * F.pow(m, F.lit(3.0))) + 1 / (1260 * F.pow(m, F.lit(5.0)))
    rise = F.lit(0.0)
    for k in range(1, 11):
        rise = rise + F.ln(n + F.lit(float(k)))
    return far - rise


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(marked: Column, others: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` blocks are marked, by inversion of the law at ``u`` in [0, 1).

    Terms beyond 9 standard deviations (less than 1e-17 in all) are left out.
    """

    def bounds(v: Column) -> Column:
        k, o, n = v["k"], v["o"], v["n"]
        size = F.greatest(k + o, F.lit(1.0))
        mean = n * k / size
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (o / size) * (size - n) / F.greatest(size - 1, F.lit(1.0))))
        a = F.greatest(F.greatest(F.lit(0.0), n - o), F.floor(mean - 9 * sd - 2).cast("double"))
        b = F.least(F.least(k, n), F.ceil(mean + 9 * sd + 2).cast("double"))
        return F.struct(k.alias("k"), o.alias("o"), n.alias("n"), v["u"].alias("u"), a.alias("a"), b.alias("b"))

    def invert(v: Column) -> Column:
        k, o, n, a, lf = v["k"], v["o"], v["n"], v["a"], _log_factorial
        log_p = lf(k) - lf(a) - lf(k - a) + lf(o) - lf(n - a) - lf(o - n + a) - lf(k + o) + lf(n) + lf(k + o - n)
        start = F.struct(F.exp(log_p).alias("p"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("x"))

        def step(s: Column, i: Column) -> Column:
            c, x = s["c"] + s["p"], a + i
            up = F.when(x < v["b"], s["p"] * (k - x) * (n - x) / ((x + 1) * (o - n + x + 1))).otherwise(F.lit(0.0))
            return F.struct(up.alias("p"), c.alias("c"), (s["x"] + F.when(c <= v["u"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("x"))

        drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), (v["b"] - a).cast("long")), start, step)["x"]
        return F.least(v["b"], a + drawn).cast("long")

    given = F.struct(marked.cast("double").alias("k"), others.cast("double").alias("o"), draws.cast("double").alias("n"), u.alias("u"))
    return _bind(given, lambda v: _bind(bounds(v), invert))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 62)) / F.lit(U63)


def tree(quotas: DataFrame, n_shards: int, shard_blocks: int, seed: int) -> DataFrame:
    """Leaves ``shard, sid, first, blocks`` from rows of ``sid, blocks``.

    Shard i holds blocks i * shard_blocks onwards of the total; the last may hold fewer.
    """
    q = F.struct("sid", F.lit(0).cast("long").alias("first"), "blocks")
    node = quotas.where("blocks > 0").agg(F.array_sort(F.collect_list(q)).alias("q"), F.sum("blocks").alias("n"))  # a row a source
    node = node.where("n > 0").select(F.lit(0).cast("long").alias("shard"), F.lit(n_shards).cast("long").alias("shards"), "n", "q")
    for level in range(max(0, math.ceil(math.log2(max(1, n_shards))))):
        half = F.ceil(F.col("shards") / 2).cast("long")
        to_left = F.when(F.col("shards") > 1, F.least(F.col("n"), half * shard_blocks)).otherwise(F.col("n"))
        node = node.withColumn("to_left", to_left)
        begin = F.struct(F.col("to_left").alias("draws"), F.col("n").alias("left"), F.array().cast("array<struct<sid:bigint,first:bigint,blocks:bigint,take:bigint>>").alias("out"))

        def draw(s: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), x["sid"])  # noqa: B023
            take = F.when(F.col("shards") > 1, hypergeometric(x["blocks"], s["left"] - x["blocks"], s["draws"], u)).otherwise(x["blocks"])
            one = lambda t: F.struct((s["draws"] - t).alias("draws"), (s["left"] - x["blocks"]).alias("left"), F.concat(s["out"], F.array(F.struct(x["sid"].alias("sid"), x["first"].alias("first"), x["blocks"].alias("blocks"), t.alias("take")))).alias("out"))
            return _bind(take, one)

        node = node.withColumn("d", F.aggregate("q", begin, draw)["out"])
        some = lambda a: F.filter(a, lambda x: x["blocks"] > 0)
        go_left = some(F.transform("d", lambda x: F.struct(x["sid"].alias("sid"), x["first"].alias("first"), x["take"].alias("blocks"))))
        go_right = some(F.transform("d", lambda x: F.struct(x["sid"].alias("sid"), (x["first"] + x["take"]).alias("first"), (x["blocks"] - x["take"]).alias("blocks"))))
        kids = F.array(
            F.struct(F.col("shard").alias("shard"), F.when(F.col("shards") > 1, half).otherwise(F.col("shards")).alias("shards"), F.col("to_left").alias("n"), go_left.alias("q")),
            F.struct((F.col("shard") + half).alias("shard"), (F.col("shards") - half).alias("shards"), (F.col("n") - F.col("to_left")).alias("n"), go_right.alias("q")),
        )
        node = node.select(F.explode(F.filter(kids, lambda x: (x["shards"] > 0) & (x["n"] > 0))).alias("k")).select("k.*")
        if level % 5 == 4:
            node = settle(node).repartition("shard")  # spread the nodes
    return node.select("shard", F.explode("q").alias("x")).select("shard", "x.*")


def _primes(n: int, below: int) -> list[int]:
    """The ``n`` greatest primes below a number."""
    found: list[int] = []
    while len(found) < n:
        below -= 1
        if all(below % d for d in range(2, math.isqrt(below) + 1)):
            found.append(below)
    return found


_STRIDES = _primes(32, 1 << 30)


def permuted(place: Column, blocks: Column, salt: Column | None = None) -> Column:
    """A block number for each place below ``blocks``: a bijection; ``salt`` chooses its stride (a prime) and its start."""
    salt = F.lit(0).cast("long") if salt is None else salt
    strides = F.array(*[F.lit(p).cast("long") for p in _STRIDES])
    at = lambda k: F.get(strides, F.pmod(salt + k, F.lit(len(_STRIDES))).cast("int"))
    stride = F.coalesce(*[F.when(blocks % at(k) != 0, at(k)) for k in range(3)], F.lit(1).cast("long"))
    start = F.pmod(F.xxhash64(salt), blocks)
    return F.pmod((stride % blocks) * place + start, blocks).cast("long")


@dataclass
class Mix:
    """``rows``: the input rows with their place; ``leaves``: the block runs of each shard."""

    rows: DataFrame
    leaves: DataFrame
    block_words: int
    seed: int

    def drawn(self) -> DataFrame:
        """The blocks that the leaves draw: ``shard, rank, sid, block``; ``rank`` orders those of a shard."""
        place = F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1))
        b = self.leaves.select("shard", "sid", "n_blocks", place.alias("place"))
        b = b.select("shard", "sid", permuted(F.col("place"), F.col("n_blocks"), F.xxhash64(F.lit(self.seed + 3), "sid")).alias("block"))
        return b.withColumn("rank", F.xxhash64(F.lit(self.seed + 2), "shard", "sid", "block"))

    def segments(self) -> DataFrame:
        """What each shard takes: ``shard, rank, doc_id, source, row, pass, at, start, length`` (words).

        A shard is read by ``rank`` and, inside a block, by ``at``; ``start`` counts words of the row's text.
        """
        keep = ["shard", "rank", "doc_id", "source", "row", "pass", "at", "start", "length", "block"]
        return self._cuts().where("length > 0").join(self.drawn().hint("merge"), ["sid", "block"]).select(*keep)

    def _cuts(self) -> DataFrame:
        """Each row's overlaps with the blocks of its source's quota; a row without any stays with length 0."""
        b = F.lit(self.block_words).cast("long")
        d = self.rows
        first = F.col("pass") * F.col("source_size") + F.col("pos")
        epochs = F.ceil(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
        d = d.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), epochs - 1)))).withColumn("at", first)
        end = F.least(F.col("at") + F.col("size"), F.col("quota"))
        d = d.withColumn("end", end).where((F.col("pass") == 0) | (F.col("end") > F.col("at")))
        blocks = F.sequence(F.floor(F.col("at") / b), F.floor(F.greatest(F.col("end") - 1, F.col("at")) / b))
        d = d.withColumn("block", F.explode(blocks))
        lo = F.greatest(F.col("at"), F.col("block") * b)
        hi = F.least(F.col("end"), (F.col("block") + 1) * b)
        return d.withColumn("length", F.greatest(F.lit(0).cast("long"), hi - lo)).withColumn("start", lo - F.col("at"))

    def taken(self) -> DataFrame:
        """Every input row once: ``doc_id, source, row, size, source_size, target, taken``, and
        the first ``shard`` and ``rank`` that take of it, with the number of ``shards`` that do.
        """
        keys = ["row", "doc_id", "source", "size", "source_size", "target"]
        cut = self._cuts().select(*keys, "sid", "block", "length").join(self.drawn().hint("merge"), ["sid", "block"], "left")
        got = F.when(F.col("shard").isNotNull() & (F.col("length") > 0), F.col("length"))
        first = F.min(F.when(got.isNotNull(), F.struct("shard", "rank")))
        shards = F.size(F.collect_set(F.when(got.isNotNull(), F.col("shard")))).cast("long")
        out = cut.groupBy(*keys).agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"), first.alias("f"), shards.alias("shards"))
        return out.select(*keys, "taken", "f.shard", "f.rank", "shards")


def mix(docs: DataFrame, weights: list[int] = (1, 2, 3), max_epochs: int = 3, block_words: int = 1 << 12, shard_blocks: int = 32, bucket_rows: int = 4096, seed: int = 11) -> Mix:
    """Plan the mix of ``docs`` (``doc_id, text, source``) over shards of ``shard_blocks`` blocks."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source").alias("h"))
    # A row number for each row; files are read again in the same order, and this copy is kept.
    base = settle(base.withColumn("row", F.monotonically_increasing_id()))
    src = targets(base.groupBy(_key(F.col("source")).alias("src")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), list(weights), max_epochs)
    src = settle(src.withColumn("sid", F.row_number().over(Window.orderBy("src")).cast("long") - 1).withColumn("quota", F.least(F.round("target").cast("long"), F.lit(max_epochs) * F.col("source_size"))).withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows).cast("long")))
    d = small_join(base.withColumn("src", _key(F.col("source"))), src, ["src"])
    d = settle(d.withColumn("bucket", F.pmod("h", F.col("buckets"))).drop("src", "buckets", "n_rows"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = d.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("head", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = settle(d.join(heads, ["sid", "bucket"]).withColumn("pos", F.col("head") + F.col("within")).drop("head", "within", "bucket", "h"))
    quotas = src.select("sid", F.ceil(F.col("quota") / F.lit(block_words)).cast("long").alias("blocks"))
    n_blocks = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    leaves = tree(quotas, max(1, math.ceil(n_blocks / shard_blocks)), shard_blocks, seed + 1)
    leaves = settle(small_join(leaves, quotas.select("sid", F.col("blocks").alias("n_blocks")), ["sid"]))
    return Mix(rows, leaves, block_words, seed)

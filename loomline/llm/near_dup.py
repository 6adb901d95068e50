"""MinHash near-duplicates with HyperMinHash registers (Yu and Weber, 2017).

1. A pass over all texts makes each row's set of distinct word shingles (64-bit hashes), a
   128-bit key of the set, and a sketch: per bucket the least hash, kept as its count of
   leading zeros and ``MANTISSA`` further bits.  Empty buckets borrow from another bucket.
2. Rows with equal sets are one class from here on.
3. Bands of compressed registers are hashed; classes that share a band are candidates.  Each
   first meets one leader of its bands; what is left apart is searched from pivots (see
   ``graph.search_bands``).
4. Comparison: what two sets can have in common at most (their sizes less the shingles that
   no other candidate has), then the collision-corrected Jaccard estimate of the registers
   (``MARGIN`` below the threshold passes), then the exact size of the intersection.
5. Linked classes merge by connected components.

Null or blank text: no shingles, linked with nothing, its own component.  Fewer words than
a shingle: the whole sequence counts as one.  Repeated rows are each returned.  A row with
null ``doc_id`` takes part and is returned; a component id is the least non-null ``doc_id``
(null if there is none).  Ties between pivots go by a hash of the class and change no
component.  A very long text is read whole: its set is one row, its sketch has a fixed size.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import settle, small_join, tidy

ROWS, BANDS, MANTISSA = 6, 40, 10
REGISTERS = ROWS * BANDS
FEW = 8
MARGIN = 0.16  # over five and a half standard deviations: the estimate's is 0.028 at most (sets of 13 shingles)
_COLLISIONS = 0.169919487159739093975315012348  # of two random sets of one size, in a register, for no mantissa (Yu and Weber)

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int, known: _Words) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a text."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    x = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        x = (x ^ h[i : len(h) - n + 1 + i]) * _M[i % 5] + _M[(i + 1) % 5]
        x ^= x >> np.uint64(29)
    return np.unique(_mix(x))


_PROBE = np.argsort(np.random.default_rng(5).random((REGISTERS, REGISTERS)), 1).astype(np.int16)
_EDGES = np.array([-(-(i << 64) // REGISTERS) for i in range(REGISTERS)], np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty sorted set."""
    at = np.searchsorted(s, _EDGES)
    nonempty = np.append(at[1:], len(s)) > at
    low = s[np.minimum(at, len(s) - 1)] * np.uint64(REGISTERS)  # place within the bucket, as a fraction of 2**64
    exponent = np.frexp(np.maximum(low, 1).astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    reg = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not nonempty.all():
        empty = np.flatnonzero(~nonempty)
        order = _PROBE[empty]
        reg[empty] = reg[order[np.arange(len(empty)), nonempty[order].argmax(1)]]
    return reg


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows for sets of n and m, less the expected chance matches.

    Two disjoint sets agree in a register by chance the oftener, the nearer their sizes are.
    """
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    return (a == b).mean(1) - _COLLISIONS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _sketch_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for t in _bytes(b.column("text")):
                s = shingle_set(t or b"", words, known)
                raw = s.tobytes()
                n.append(len(s))
                k1.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                k2.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                sig.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])

    return run


def _set_rows(words: int, nameless: bool = False):
    """Sets by ``cid``, of texts that have the class's key; or, nameless, by the key itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            got = []
            for c, k1, k2, t in zip(b.column("cid").to_pylist(), b.column("k1").to_pylist(), b.column("k2").to_pylist(), _bytes(b.column("text"))):
                raw = shingle_set(t or b"", words, known).tobytes()
                key = xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63)
                if nameless:
                    got.append((*key, raw))
                elif key == (k1, k2):
                    got.append((c, raw))
            columns = list(zip(*got)) or [()] * (3 if nameless else 2)
            names = ["k1", "k2", "set"] if nameless else ["cid", "set"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "set" else pa.int64()) for c, n in zip(columns, names)], names=names)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            sets = [np.frombuffer(raw.as_buffer(), np.int64) for raw in part.column("set")]
            cid = np.repeat(part.column("cid").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.concatenate(sets))], names=["cid", "s"])


def _estimate_rows(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            est = estimate(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            ok = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def _exact_rows(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    j = pairs.select("a", "b").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
    j = j.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a")
    return j.select("a", "b", "set_a", "set_b").mapInArrow(_exact_rows(num, den), "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; links need den * both >= num * union."""
    t = num / den
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(texts.mapInArrow(_sketch_rows(words), "doc_id long, n long, k1 long, k2 long, sig binary"))
    classes = settle(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()))
    # Two different sets can only be linked from this size on.
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    bands = classes.where(F.col("n") >= t / (1 - t + 1e-9) - 1e-6).select("cid", "n", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).where("c > 1").select("key")
    bands = settle(bands.join(shared, "key"))
    labels = settle(bands.select("cid").distinct().withColumn("label", F.col("cid")))
    need = settle(classes.join(labels, "cid", "left_semi").select("cid", "k1", "k2", F.col("rep").alias("doc_id")))
    sets = settle(_sets(texts, need, words))
    # Shingles that no other candidate has lie in no intersection.
    alone = sets.mapInArrow(_members, "cid long, s long").groupBy("s").agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c = 1")
    own = alone.groupBy("cid").agg(F.count("*").alias("own"))
    bands = bands.join(own, "cid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    bands = settle(bands.where((F.col("n") - F.col("own")) * den >= F.col("n") * num))
    both = F.least(F.col("n") - F.col("own"), F.col("pn") - F.col("pown"))
    near = both * den >= (F.col("n") + F.col("pn") - both) * num
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))

    def refine(mine: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Count shingles of few of the classes left as their own; pairs that share one come apart.

        A shingle of at most ``FEW`` classes makes at most that many pairs for each.
        """
        left = settle(mine.groupBy("cid").agg(F.max("label").alias("label"), F.max("n").alias("n")))
        rows = sets.join(left, "cid", "left_semi").mapInArrow(_members, "cid long, s long")
        few = rows.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") <= FEW)
        rare = settle(rows.join(few, "s").join(left, "cid"))
        shared = rare.where("c > 1")
        other = shared.select("s", F.col("cid").alias("p"), F.col("label").alias("pl"), F.col("n").alias("pn"))
        sizes = (F.col("n") * den >= F.col("pn") * num) & (F.col("pn") * den >= F.col("n") * num)
        pairs = shared.join(other, "s").where((F.col("cid") < F.col("p")) & (F.col("label") != F.col("pl")) & sizes)
        mine = mine.drop("own").join(rare.groupBy("cid").agg(F.count("*").alias("own")), "cid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        mine = settle(mine.where((F.col("n") - F.col("own")) * den >= F.col("n") * num))
        return mine, pairs.select(F.col("cid").alias("a"), F.col("p").alias("b")).distinct()

    def compare(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimate_rows(t - MARGIN), "a long, b long")
        return graph.merged(labels, settle(_verified(likely, sets, num, den)))

    labels = graph.search_bands(bands, labels, near, compare, refine, few_bands=True)
    known = classes.select("cid", "k1", "k2", "rep").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "label").select("k1", "k2", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets(texts: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """The full set of each needed class, from one of its rows."""
    found = small_join(texts.where("doc_id is not null"), need.where("doc_id is not null"), ["doc_id"])
    sets = found.select("cid", "k1", "k2", "text").mapInArrow(_set_rows(words), "cid long, set binary")
    nameless = need.where("doc_id is null").select("cid", "k1", "k2")
    if not nameless.isEmpty():
        keyed = texts.where("doc_id is null").select(F.lit(0).cast("long").alias("cid"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "text").mapInArrow(_set_rows(words, True), "k1 long, k2 long, set binary")
        sets = sets.unionByName(keyed.join(nameless, ["k1", "k2"]).select("cid", "set"))
    return sets.dropDuplicates(["cid"])

"""Exact top-k inner products by norm-bucketed retrieval (Teflioudi and Gemulla, 2015).

Vectors are ordered by length and cut into buckets of about ``bucket_rows``.  A first pass over
the bucket of the longest vectors gives each query a score that its k-th best reaches at
least, and with it the least length of a useful vector.  Queries that need a like length share
a block.  For each bucket follows the least cosine that a useful vector must have there:

* above 1: the bucket is skipped;
* high: coordinate pruning, by the range that the query's largest coordinate allows;
* else: length pruning, by the prefix of vectors that are long enough.

What is left is verified by exact integer products.  Equal lengths are spread by a hash.

Vectors that are null, or hold null, NaN or infinite components, and rows without an id
take no part.  Only vectors of equal dimension meet.  An id that repeats is queried once,
by its least vector; as candidates its rows count one by one, but never for a query of the
same id.  Ties go to the smaller id.  Fewer than k candidates: all of them.  Products beyond
64 bits are held at the 64-bit limits.  Long vectors are read whole: a bucket is one row, so
``bucket_rows`` is for vectors of some thousand components at most.  Where all vectors have one
length no bucket can be skipped, and every product is made.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tidy

PACK = "dim long, top double, ids binary, vectors binary, norms binary"
COORDINATE_FROM = 0.8


def whole(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id, v`` with each component as floor(scale * x), of the vectors that take part."""
    x = F.col(column)
    ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    good = vectors.where(F.col(id_column).isNotNull() & x.isNotNull()).where(F.forall(x, ok))
    return good.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).cast("array<long>").alias("v"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def _packer(rows: int):
    def pack(ids: list, vs: list) -> list:
        v = np.array(vs, np.int64).reshape(len(vs), -1)
        norms = np.sqrt((v.astype(float) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        return [v.shape[1], float(norms.max()), np.array(ids, np.int64)[order].tobytes(), v[order].tobytes(), norms[order].tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def emit(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["dim", "top", "ids", "vectors", "norms"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i), vs.append(v)
                if len(ids) >= rows:
                    yield emit([pack(*held.pop(len(v)))])
        for dim in sorted(held):
            yield emit([pack(*held[dim])])

    return run


def _unpack(b: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, v, norms = (np.frombuffer(b.column(f"{side}_{c}")[i].as_buffer(), t) for c, t in (("ids", np.int64), ("vectors", np.int64), ("norms", np.float64)))
    return ids, v.reshape(len(ids), -1), norms


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ p.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_bucket(q_ids, q, q_norms, floor, p_ids, p, p_norms, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of up to k best for each query that reach its ``floor`` (NaN: none known)."""
    out = []
    long_enough = np.where((q_norms > 0) & (floor > 0), floor / np.maximum(q_norms, 1e-300), -1.0) * (1 - 1e-9)
    prefix = np.where(np.isnan(floor), len(p), np.searchsorted(-p_norms, -long_enough, side="right"))
    cosine = np.where(np.isnan(floor), -1.0, long_enough / max(p_norms[0], 1e-300))

    def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = p_ids[at] != q_ids[i]
        if not np.isnan(floor[i]):
            ok &= scores >= floor[i]
        at, scores = at[ok], scores[ok]
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        best = np.lexsort((p_ids[at], -scores))[:k]
        out.extend(zip([int(q_ids[i])] * len(best), p_ids[at][best].tolist(), scores[best].tolist()))

    by_coordinate = (cosine > COORDINATE_FROM) & (cosine <= 1) & (prefix > 64)
    by_length = ~by_coordinate & (prefix > 0)
    if by_length.any():
        rows = np.flatnonzero(by_length)
        most = int(prefix[rows].max())
        scores = _products(q[rows], p[:most])
        for r, i in enumerate(rows):
            keep(i, np.arange(prefix[i]), scores[r, : prefix[i]])
    for i in np.flatnonzero(by_coordinate):
        f, t = int(np.abs(q[i]).argmax()), cosine[i]
        x = q[i, f] / q_norms[i]
        slack = math.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
        y = p[: prefix[i], f] / np.maximum(p_norms[: prefix[i]], 1e-300)
        at = np.flatnonzero((y >= x * t - slack) if x >= 0 else (y <= x * t + slack))
        keep(i, at, _products(q[i : i + 1], p[at])[0])
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, q, qn = _unpack(b, i, "q")
                raw = b.column("q_floor")[i]
                floor = np.frombuffer(raw.as_buffer(), np.float64) if raw.is_valid else np.full(len(qi), np.nan)
                got = best_of_bucket(qi, q, qn, floor, *_unpack(b, i, "p"), k)
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _floors(k: int):
    """Each query with the k-th best score that it has in the first bucket (-inf: fewer than k), and how long a vector must be to reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, q, qn = _unpack(b, i, "q")
                got = best_of_bucket(qi, q, qn, np.full(len(qi), np.nan), *_unpack(b, i, "p"), k)
                scores: dict[int, list[int]] = {}
                for x, _, s in got:
                    scores.setdefault(x, []).append(s)
                f = np.array([min(scores[x]) if len(scores.get(x, ())) >= k else -np.inf for x in qi.tolist()], float)
                ratio = np.where((f > 0) & (qn > 0), f / np.maximum(qn, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(q.tolist(), pa.list_(pa.int64())), pa.array(f), pa.array(ratio), pa.array(np.full(len(qi), q.shape[1]))], names=["id", "v", "floor", "ratio", "dim"])

    return run


def _query_blocks(rows: int):
    """Queries packed in the order in which they come; ``ratio``: the least length that any of them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, vs, floor, ratio = zip(*held.pop(dim))
            v = np.array(vs, np.int64).reshape(len(vs), -1)
            norms = np.sqrt((v.astype(float) ** 2).sum(1))
            row = [dim, np.array(ids, np.int64).tobytes(), v.tobytes(), norms.tobytes(), np.array(floor, float).tobytes(), float(min(ratio))]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["dim", "q_ids", "q_vectors", "q_norms", "q_floor", "ratio"])

        for b in batches:
            for i, v, floor, ratio in zip(*(b.column(c).to_pylist() for c in ("id", "v", "floor", "ratio"))):
                mine = held.setdefault(len(v), [])
                mine.append((i, v, floor, ratio))
                if len(mine) >= rows:
                    yield emit(len(v))
        for dim in sorted(held):
            yield emit(dim)

    return run


def _side(df: DataFrame, side: str) -> DataFrame:
    """``df`` with the columns of a pack named after a side."""
    return df.select(*[F.col(c).alias(f"{side}_{c}") if c in ("ids", "vectors", "norms", "top") else F.col(c) for c in df.columns])


@tidy
def top_k(vectors: DataFrame, queries: Column, k: int = 5, bucket_rows: int = 2048, block_rows: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: vectors ``id, v`` (see ``whole``); ``queries`` marks query rows."""
    v = settle(vectors.withColumn("norm", _norm(F.col("v"))).withColumn("h", F.xxhash64("id")))
    asked = v.where(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, n_q = v.count(), v.where(queries).count()
    parts, q_parts = max(1, math.ceil(n / bucket_rows)), max(1, math.ceil(n_q / block_rows))
    buckets = v.repartitionByRange(parts, F.desc("norm"), "h").select("id", "v").mapInArrow(_packer(bucket_rows * 2), PACK)
    buckets = settle(buckets.withColumn("bucket", F.monotonically_increasing_id()))
    meta = settle(buckets.select("bucket", "dim", "top").withColumn("slot", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("top"), "bucket"))))  # a row a bucket
    # The bucket of the longest vectors of each dimension: one row a dimension.
    first = _side(buckets.join(meta.where("slot = 1").select("bucket"), "bucket").drop("bucket"), "p")
    met = _side(asked.repartition(q_parts, "id").mapInArrow(_packer(block_rows), PACK), "q").join(first, "dim")
    found = settle(met.mapInArrow(_floors(k), "id long, v array<long>, floor double, ratio double, dim long"))
    # Queries that need vectors of like length share a block, so that a block skips most buckets that its queries can skip.
    blocks = found.repartitionByRange(q_parts, "dim", F.desc("ratio"), "id").sortWithinPartitions("dim", F.desc("ratio"), "id")
    blocks = blocks.mapInArrow(_query_blocks(block_rows), "dim long, q_ids binary, q_vectors binary, q_norms binary, q_floor binary, ratio double")
    blocks = settle(blocks.withColumn("block", F.monotonically_increasing_id()))
    # A row for each block and bucket that are searched together: the work itself, each some thousand products.
    pairs = blocks.select("block", "dim", "ratio").join(meta, "dim").where(F.col("ratio") * (1 - 1e-9) <= F.col("top")).select("block", "bucket")
    work = pairs.join(_side(buckets.drop("dim"), "p"), "bucket").join(blocks.drop("dim", "ratio"), "block")
    hits = work.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

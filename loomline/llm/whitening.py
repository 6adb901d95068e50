"""Whitening of vectors by a tiled covariance.

1. Sums of each dimension are exact, over all rows.
2. Rows are cut into row-blocks, and these into column blocks of ``tile`` centred dimensions.
   Column blocks of one row-block meet, in pairs; each pair of column blocks is a tile key.
   A task multiplies its pairs and adds them up by tile; the sums of a tile are added once more.
3. The tiles of a covariance (dimensions squared, however many rows) are assembled on the
   driver, whose eigenvectors then project the rows where they lie.

Vectors that are null or hold null, NaN or infinite entries take no part.  Vectors of different
dimension are whitened apart, each by those of its own dimension; empty vectors have no
components.  Repeated rows and rows without an id count and are returned.  Ties between
eigenvalues keep the order of the solver; the largest entry of an eigenvector is positive.  A
direction without variance (to 1e-12 of the trace) is whitened to 0 and left out of the
identity's error.  Scaled entries beyond 2**40 are held there, deviations beyond 64 bits at the
limit.  Very long vectors: the covariance must fit the driver, so ``most_dims`` bounds them; more
is an error.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy

_HELD = float(1 << 40)


def whole(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``id, kind, v``: each entry as ``floor(scale * c) + shift``, and the dimension, of the vectors that take part."""
    x = F.col(column)
    ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    held = lambda e: F.greatest(F.least(e.cast("double") * scale, F.lit(_HELD)), F.lit(-_HELD))
    v = F.transform(x, lambda e: F.floor(held(e)) + F.lit(shift)).cast("array<long>")
    return vectors.where(x.isNotNull()).where(F.forall(x, ok)).select(F.col(id_column).cast("long").alias("id"), F.size(x).cast("long").alias("kind"), v.alias("v"))


@dataclass(frozen=True)
class Moments:
    """Rows, sums and covariance (divisor n) of the vectors of one kind; the sums are exact for whole numbers."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray

    def centred(self, v: np.ndarray) -> np.ndarray:
        return centred(v, self.n, self.sums)


def centred(v: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``v`` less the mean; of whole numbers the whole part of the mean goes first, exactly."""
    if v.dtype.kind != "i":
        return v - sums / n
    whole_part = np.floor_divide(sums, n)
    return (v - whole_part).astype(float) - (sums - whole_part * n).astype(float) / n


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, which rows, their vectors as a matrix) of a batch."""
    kinds, lists = b.column("kind").to_numpy(), b.column("v")
    for k in np.unique(kinds):
        at = np.flatnonzero(kinds == k)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        if len(flat):
            yield int(k), at, flat.reshape(len(at), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for b in batches:
        for k, at, m in _matrices(b):
            was = found.setdefault(k, [0, np.zeros(m.shape[1], m.dtype)])
            was[0] += len(at)
            was[1] = was[1] + m.sum(0)
    for k, (n, s) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(s), pa.int64()), pa.array(np.arange(len(s))), pa.array([n] * len(s), pa.int64()), pa.array(s)], names=["kind", "pos", "n", "s"])


def _column_blocks(tile: int, sums: dict[int, tuple[int, np.ndarray]], cells: int):
    """Row-blocks of centred vectors (some ``cells`` numbers each), as their column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def emit(k: int) -> pa.RecordBatch:
            m = centred(np.concatenate(held.pop(k)), *sums[k])
            data = [np.ascontiguousarray(m[:, c : c + tile]).tobytes() for c in range(0, m.shape[1], tile)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(m)], pa.int64()), pa.array([data], pa.list_(pa.binary()))], names=["kind", "n", "data"])

        for b in batches:
            for k, _, m in _matrices(b):
                held.setdefault(k, []).append(m)
                if sum(x.size for x in held[k]) >= cells:
                    yield emit(k)
        for k in list(held):
            yield emit(k)

    return run


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of pairs of column blocks, added up by tile."""
    tiles: dict[tuple[int, int, int], np.ndarray] = {}

    def emit() -> pa.RecordBatch:
        cols = list(zip(*tiles)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([t.tobytes() for t in tiles.values()], pa.binary())], names=["kind", "i", "j", "data"])

    for b in batches:
        for r in range(b.num_rows):
            k, i, j, n = (b.column(c)[r].as_py() for c in ("kind", "i", "j", "n"))
            x, y = (np.frombuffer(b.column(c)[r].as_buffer(), float).reshape(n, -1) for c in ("x", "y"))
            was, part = tiles.get((k, i, j)), x.T @ y
            tiles[k, i, j] = part if was is None else was + part
        if sum(t.nbytes for t in tiles.values()) > 64 << 20:
            yield emit()
            tiles.clear()
    yield emit()


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("data"))
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int64()), "i": pa.array([key[1].as_py()], pa.int64()), "j": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def moments(vectors: DataFrame, tile: int = 16, block_cells: int = 1 << 18, most_dims: int = 8192) -> dict[int, Moments]:
    """``Moments`` of each kind of ``vectors`` (``kind, v``; one length a kind)."""
    whole_numbers = dict(vectors.dtypes)["v"] == "array<bigint>"
    number = "long" if whole_numbers else "double"
    widest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if widest > most_dims:
        raise ValueError(f"{widest} dimensions, and most_dims is {most_dims}")
    parts = vectors.select("kind", "v").mapInArrow(_sums, f"kind long, pos long, n long, s {number}")
    sums: dict[int, tuple[int, list]] = {}
    for r in parts.groupBy("kind", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("kind", "pos").toLocalIterator():
        sums.setdefault(r["kind"], (r["n"], []))[1].append(r["s"])
    fixed = {k: (n, np.array(s, np.int64 if whole_numbers else float)) for k, (n, s) in sums.items()}
    rows = vectors.select("kind", "v").mapInArrow(_column_blocks(tile, fixed, block_cells), "kind long, n long, data array<binary>")
    rows = settle(rows.withColumn("block", F.monotonically_increasing_id()))
    x = rows.select("kind", "block", "n", F.posexplode("data").alias("i", "x"))
    y = rows.select("kind", "block", F.posexplode("data").alias("j", "y"))
    tiles = x.join(y, ["kind", "block"]).where("i <= j").select("kind", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", "x", "y").mapInArrow(_multiply, "kind long, i long, j long, data binary")
    out = {k: np.zeros((len(s), len(s))) for k, (_, s) in fixed.items()}
    for r in tiles.groupBy("kind", "i", "j").applyInArrow(_added, "kind long, i long, j long, data binary").toLocalIterator():
        m, i, j = out[r["kind"]], r["i"] * tile, r["j"] * tile
        t = np.frombuffer(r["data"], float).reshape(min(tile, len(m) - i), -1)
        m[i : i + t.shape[0], j : j + t.shape[1]] = t
        m[j : j + t.shape[1], i : i + t.shape[0]] = t.T
    return {k: Moments(n, s, out[k] / n) for k, (n, s) in fixed.items()}


@dataclass(frozen=True)
class Axes:
    """Unit eigenvectors (columns) by falling eigenvalue, and what they explain."""

    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def real(self) -> np.ndarray:
        return self.explained > 1e-12


def axes(covariance: np.ndarray, components: int) -> Axes:
    e, u = np.linalg.eigh(covariance)
    e, u = np.maximum(e[::-1][:components], 0), u[:, ::-1][:, :components]
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = np.trace(covariance)
    return Axes(e, u, e / trace if trace > 0 else np.zeros_like(e))


def _deviations(m: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums of squares of ``n * m - sums``."""
    far = int(np.abs(m - np.floor_divide(sums, n)).max(initial=0)) + 1
    if n * (int(np.abs(m).max(initial=0)) + 1) < 1 << 62 and (n * far) ** 2 * m.shape[1] < 1 << 62:
        d = m * n - sums
        return (d * d).sum(1).tolist()
    d = m.astype(object) * n - sums.astype(object)
    return [min(x, (1 << 63) - 1) for x in (d * d).sum(1).tolist()]


def _whitened(fits: dict[int, tuple[int, np.ndarray, Axes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, at, m in _matrices(b):
                n, sums, a = fits[k]
                by = a.vectors * np.where(a.real, 1 / np.sqrt(np.where(a.real, a.values, 1)), 0)
                z = centred(m, n, sums) @ by
                cols = [b.column("id").take(pa.array(at)), pa.array([k] * len(at), pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array(_deviations(m, n, sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "kind", "n", "deviation", "v"])

    return run


@tidy
def whiten(vectors: DataFrame, components: int = 32, tile: int = 16) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of ``id, kind, v`` (see ``whole``)."""
    spark = vectors.sparkSession
    v = settle(vectors)
    fits = {k: (m.n, m.sums, axes(m.covariance, components)) for k, m in moments(v, tile).items()}
    rows = settle(v.mapInArrow(_whitened(fits), "id long, kind long, n long, deviation long, v array<double>"))
    facts = []
    for k, m in moments(rows.select("kind", "v"), tile).items():
        a = fits[k][2]
        off = m.covariance - np.eye(len(m.covariance))
        error = float(np.abs(off[np.ix_(a.real, a.real)]).max(initial=0))
        facts += [(k, c + 1, float(x), error) for c, x in enumerate(a.explained)]
    explained = spark.createDataFrame(facts, "kind long, component int, explained double, identity_error double")
    each = rows.select("id", "kind", "n", "deviation", F.posexplode("v").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return each.join(explained, ["kind", "component"]).select("id", "component", "n", "deviation", "whitened", "explained", "identity_error")

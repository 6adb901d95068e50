"""Media columns: chroma fingerprints of audio, and their alignment.

Audio is turned into pitch-class frames (energy of the 12 classes).  Sixteen rectangular
filters slide over them; sums come from an integral image, each filter compares two areas
by the logarithm of the ratio of their means, three thresholds make two Gray-coded bits, and so each
position gives one packed 32-bit integer.

Recordings are compared if two integers of theirs at most ``GAPS`` places apart are equal and
differ from each other (so neither silence nor a held tone makes recordings meet).  Audio is
read at two phases, half a frame step apart, so that a copy that starts anywhere is within a
quarter of a step of one of them.  A histogram of the offsets at which parts of integers agree
gives the likeliest offsets, and the least share of differing bits over the whole overlap there
decides.  Equal fingerprints are one class first; each class then meets one leader of those it
shares a key with, and what is left apart is searched from pivots (``graph.search_bands``), so
a very common passage doesn't make pairs of everything.

Null media, too few frames, or media that can't be read: no fingerprint, linked with
nothing.  Repeated rows are each returned.  A null id takes part; a group's id is the least
non-null id.  Ties between offsets go to the one with the least bit error, then the least
offset.  A very long recording is read whole: its fingerprint is one row.  Empty table: no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import settle, tidy

FRAME, STEP, LOW_HZ, HIGH_HZ = 4096, 1365, 28.0, 3520.0
WIDEST = 16
GAPS = (1, 2, 3)
THRESHOLDS = (-0.1, 0.0, 0.1)


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, lowest class, classes, frames) by rule: six shapes over growing areas."""
    widths, heights = (4, 7, 10, 13, WIDEST), (3, 5, 8, 12)
    return [(i % 6, min((5 * i) % 12, 12 - heights[i % 4]), heights[i % 4], widths[i % 5]) for i in range(16)]


FILTERS = _filters()


def frames_of_wav(data: bytes, skip: int = 0) -> np.ndarray:
    """Pitch-class frames of a PCM WAV file (mono mix, 16 bit), from sample ``skip`` on."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        if width != 2:
            raise ValueError("16-bit samples are needed")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)[skip:]
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    classes = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    out, window = [], np.hamming(FRAME)
    for at in range(0, len(x) - FRAME + 1, STEP):
        power = np.abs(np.fft.rfft(x[at : at + FRAME] * window))[use] ** 2
        out.append(np.bincount(classes, power, 12))
    return np.array(out).reshape(-1, 12)


def frames_of_vector(values: list) -> np.ndarray:
    """A vector read as a melody: frame i holds the sizes of components i to i + 11."""
    v = np.abs(np.array(values, float))
    return np.lib.stride_tricks.sliding_window_view(v, 12) if len(v) >= 12 else np.empty((0, 12))


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One uint32 for each position at which the widest filter fits."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    norm = np.linalg.norm(frames, axis=1, keepdims=True)
    image = np.divide(frames, norm, out=np.zeros_like(frames, dtype=float), where=norm > 1e-9)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    start = np.arange(n)

    def area(x0, x1, y0, y1):
        """Mean over frames start+x0..start+x1 and classes y0..y1."""
        total_here = total[start + x1, y1] - total[start + x0, y1] - total[start + x1, y0] + total[start + x0, y0]
        return total_here / ((x1 - x0) * (y1 - y0))

    out = np.zeros(n, np.uint32)
    for k, (shape, y, h, w) in enumerate(FILTERS):
        if shape == 0:  # these classes against all
            a, b = area(0, w, y, y + h // 2), area(0, w, 0, 12)
        elif shape == 1:  # upper against lower classes
            a, b = area(0, w, y + h // 2, y + h), area(0, w, y, y + h // 2)
        elif shape == 2:  # later against earlier frames
            a, b = area(w // 2, w, y, y + h), area(0, w // 2, y, y + h)
        elif shape == 3:  # opposite quarters
            a = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
            b = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif shape == 4:  # the middle third of the classes
            a, b = area(0, w, y + h // 3, y + 2 * h // 3), area(0, w, y, y + h)
        else:  # the middle third of the frames
            a, b = area(w // 3, 2 * w // 3, y, y + h), area(0, w, y, y + h)
        level = np.searchsorted(THRESHOLDS, np.log((0.01 + a) / (0.01 + b))).astype(np.uint32)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)
    return out


def align(a: np.ndarray, b: np.ndarray, least_overlap: int = 16, tries: int = 5) -> tuple[int, float] | None:
    """(offset of b in a, share of differing bits there), or None if nothing agrees.

    The offsets tried are those at which most bytes of integers agree, however long the
    recordings; agreements are counted some millions at a time.
    """
    part = 8
    hits = np.zeros(len(a) + len(b) + 1, np.int64)
    for shift in range(0, 32, part):
        x, y = ((v >> np.uint32(shift)) & np.uint32((1 << part) - 1) for v in (a, b))
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        n = high - low
        ahead = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ahead, np.arange(0, ahead[-1] + 1, 1 << 21))) if len(n) else []
        for k, end in zip(cuts, [*cuts[1:], len(n)]):  # a common byte agrees nearly everywhere
            m = n[k:end]
            i = np.repeat(np.arange(k, end), m)
            j = order[np.repeat(low[k:end] - np.concatenate([[0], m.cumsum()[:-1]]), m) + np.arange(m.sum())]
            hits += np.bincount(i - j + len(b), minlength=len(hits))
    found = None
    for at in np.argsort(-hits, kind="stable")[:tries]:
        offset = int(at) - len(b)
        x, y = a[max(0, offset) :], b[max(0, -offset) :]
        m = min(len(x), len(y))
        if hits[at] and m >= least_overlap:
            error = float(np.bitwise_count(x[:m] ^ y[:m]).sum() / (32 * m))
            found = min(found or (2.0, 0), (error, offset))
    return found and (found[1], found[0])


def fingerprints(media: DataFrame, id_column: str, column: str, kind: str) -> DataFrame:
    """``id, n, fp, fp2, k1, k2``; ``kind``: ``wav`` (bytes), ``frames`` (numbers, 12 a frame) or ``vector`` (see ``frames_of_vector``).

    ``fp2`` is audio's fingerprint half a frame step later.
    """
    step = STEP // 2

    def read(m) -> list[np.ndarray]:
        if m is None:
            return []
        return [frames_of_wav(m), frames_of_wav(m, step)] if kind == "wav" else [frames_of_vector(m) if kind == "vector" else np.array(m, float).reshape(-1, 12)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[list[bytes]] = []
            for m in b.column("m"):
                try:
                    frames = read(m.as_py())
                    if not all(np.isfinite(f).all() for f in frames):
                        frames = []
                except (ValueError, TypeError, EOFError, wave.Error):
                    frames = []
                raw.append([*(fingerprint(f).tobytes() for f in frames), b"", b""][:2])
            one, two = [r[0] for r in raw], [r[1] for r in raw]
            h = [[xxhash.xxh64_intdigest(r, s) - (1 << 63) for r in one] for s in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(r) // 4 for r in one], pa.int64()), pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(h[0]), pa.array(h[1])], names=["id", "n", "fp", "fp2", "k1", "k2"])

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("m")).mapInArrow(run, "id long, n long, fp binary, fp2 binary, k1 long, k2 long")


def pair_keys(prints: list[np.ndarray]) -> np.ndarray:
    """Distinct hashes of two different integers at each gap, of all given fingerprints of a recording."""
    out = [np.empty(0, np.uint64)]
    for x in prints:
        x = x.astype(np.uint64)
        for gap in GAPS:
            u, v = x[:-gap], x[gap:]
            h = ((u << np.uint64(32) | v) + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append((h * np.uint64(0xBF58476D1CE4E5B9))[u != v])
    return np.unique(np.concatenate(out))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [pair_keys([np.frombuffer(p, np.uint32) for p in x]) for x in zip(b.column("fp").to_pylist(), b.column("fp2").to_pylist())]
        size = [len(k) for k in own]
        key = np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(c).to_numpy(), size), pa.int64()) for c in ("cid", "n")] + [pa.array(key)], names=["cid", "n", "key"])


def _align_rows(most_errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "fp_a", "fp_b"))):
                r = align(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                if r and r[1] <= most_errors:
                    got.append((a, b, *r))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "offset", "bit_error"])

    return run


@tidy
def group(prints: DataFrame, most_errors: float = 0.15) -> DataFrame:
    """``id, n, group_id`` and, of the least class that it was aligned with, ``link_id, offset, bit_error``.

    Classes that are in one group already are not aligned with each other again.
    """
    rows = settle(prints)
    classes = settle(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("fp2").alias("fp2")).withColumn("cid", F.monotonically_increasing_id()))
    bands = classes.select("cid", "n", "fp", "fp2").mapInArrow(_keys, "cid long, n long, key long")
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    bands = settle(bands.join(shared, "key").withColumn("own", F.lit(0).cast("long")))
    labels = settle(bands.select("cid").distinct().withColumn("label", F.col("cid")))
    links: list[DataFrame] = []

    def compare(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        side = lambda c: classes.select(F.col("cid").alias(c), F.col("fp").alias(f"fp_{c}"))
        found = settle(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_align_rows(most_errors), "a long, b long, offset long, bit_error double"))
        links.append(found)
        return graph.merged(labels, found.select("a", "b"))

    labels = graph.search_bands(bands, labels, F.lit(True), compare)
    known = classes.select("cid", "k1", "k2", "rep").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    known = known.join(known.groupBy("label").agg(F.min("rep").alias("group_id")), "label")
    if links:
        both = links[0]
        for x in links[1:]:
            both = both.unionByName(x)
        both = both.select(F.col("b").alias("cid"), F.col("a").alias("other"), "offset", "bit_error").unionByName(both.select(F.col("a").alias("cid"), F.col("b").alias("other"), (-F.col("offset")).alias("offset"), "bit_error"))
        both = both.join(classes.select(F.col("cid").alias("other"), F.col("rep").alias("link_id")), "other")
        best = both.groupBy("cid").agg(F.min(F.struct("link_id", "offset", "bit_error")).alias("x")).select("cid", "x.*")
        known = known.join(best, "cid", "left")
    else:
        known = known.withColumns({"link_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "bit_error": F.lit(None).cast("double")})
    out = rows.drop("fp", "fp2").join(known.select("k1", "k2", "group_id", "link_id", "offset", "bit_error"), ["k1", "k2"], "left")
    return out.select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("group_id")).alias("group_id"), "link_id", "offset", "bit_error")

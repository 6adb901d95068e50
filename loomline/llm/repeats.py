"""Repeated passages by distributed prefix doubling (Karp, Miller and Rosenberg, 1972; Manber and Myers, 1993).

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with
a smaller id.  Positions carry ranks: names that are equal exactly where the strings that start
there are equal.  Names of short strings are made by hashing inside a text; from there on Spark
sorts and groups positions by names, at growing lengths, and a position whose name no other
document has is dropped before the next, longer round:

0. Rows whose whole text a smaller id has are done.
1. ``gram`` bytes.  Of each window of ``length`` bytes the least named gram stands for it, so
   equal windows, wherever they are, share a gram, and only a few positions are named.  Names
   travel packed, in buckets; those of one text alone are dropped.
2. Runs of windows with one gram are one string: its rank is a pair of names.  All but the
   first document of a rank lose the whole run.  Where a gram has one such rank only, it is done.
3. The first run of each rank: the gram with half of what is missing on its left, and on its
   right.  Sides that no other document shares are dropped.
4. What is left, each window by itself: a pair of names, at offset 0 and ``length / 2``.  Pairs
   travel packed once more, are sorted, and those of one text alone are dropped; the others are
   ranked, now past the threshold.  All but the first document lose the window.

The first round's names may collide without harm (a position stays that could go); removal
rests on pairs of 64-bit names.  Strings within one document, or in rows of the same id, remove nothing.
Rows without an id come last: they lose what any row with an id has, and take nothing away.
Null text is empty; nothing is removed from texts shorter than ``length`` bytes.  Repeated rows
are each returned.  Very long texts are read whole, in pieces that overlap.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, tidy

PIECE = 1 << 18
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * (PIECE + 1023), np.uint64))


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LETTER[a] * _UP[: len(a)], out=out[1:])
    return out


def named(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the strings ``a[start:end]`` (up to 512 bytes each): one hash of each string's bytes."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(0, len(a) + PIECE, PIECE))
    for k, (f, t) in enumerate(zip(cuts[:-1], cuts[1:])):
        if f < t:
            at, c = order[f:t], k * PIECE
            p = _sums(a[c : c + PIECE + 512])
            out[at] = _mixed((p[end[at] - c] - p[start[at] - c]) * _DOWN[start[at] - c])
    return out


def anchors(a: np.ndarray, edges: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of texts that lie one after another (``edges``: where each begins, and the end).

    For each run: its first window, how many, the place of the gram that stands for them (the
    leftmost with the least name) and that name.  Windows never cross an edge.
    """
    width = length - gram + 1
    cross = np.zeros(len(a) + 1, np.int8)
    lows = np.maximum(edges[:-1], edges[1:] - length + 1)
    np.add.at(cross, lows, 1)
    np.add.at(cross, edges[1:], -1)
    cross = np.cumsum(cross, dtype=np.int8) > 0
    found: list[tuple[np.ndarray, ...]] = []
    for c in range(0, len(a) - length + 1, PIECE):
        p = _sums(a[c : c + PIECE + length - 1])
        g = _mixed((p[gram:] - p[:-gram]) * _DOWN[: len(p) - gram])
        least, at, span = g, np.arange(len(g), dtype=np.int32), 1
        while span < width:
            step = min(span, width - span)
            later = least[step:] < least[:-step]
            at = np.where(later, at[step:], at[:-step])
            least = np.minimum(least[step:], least[:-step])
            span += step
        at = np.where(cross[c : c + len(at)], np.int32(-1), at)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(first, len(at)))
        ok = at[first] >= 0
        first, n = first[ok], n[ok]
        found.append((first + c, n, at[first].astype(np.int64) + c, g[at[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after another, and where each begins (and the end)."""
    b = column.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
    data = np.frombuffer(b.buffers()[2], np.uint8) if b.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as their lower and upper halves: the upper ones are mostly zero."""
    return x.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.view("<u2").reshape(2, -1).T).view("<u4").ravel()


#: What travels packed: a name, a row and a place, and either a run's windows and offset or a second name.
RUN, PAIR = ("<u8", "row", "row", "u1", "u1"), ("<u8", "row", "row", "<u8")


def _packed(kinds: tuple, columns: list[np.ndarray]) -> bytes:
    return b"".join(_planes(c) if k == "row" else c.astype(k).tobytes() for k, c in zip(kinds, columns))


def _unpacked(kinds: tuple, blob: pa.Scalar) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(blob.as_buffer(), np.uint8), [], 0
    width = [4 if k == "row" else np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(width)
    for k, w in zip(kinds, width):
        part = raw[at : at + w * n]
        out.append(_unplaned(part) if k == "row" else part.copy().view(k))
        at += w * n
    return out


QUESTION = "bucket long, sure boolean, base long, blob binary"


def _dealt(kinds: tuple, buckets: int, base: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed rows of ``columns`` (name, row, place, ...) by bucket.

    Of a name that several rows have here, all places are known to stay (``sure``); one of
    them, with nothing after its place, still tells the others.
    """
    name, row = columns[:2]
    if not len(name):
        return
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
    several = np.minimum.reduceat(row[order], first) < np.maximum.reduceat(row[order], first)
    many = np.zeros(len(order), bool)
    many[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    asked = np.concatenate([np.flatnonzero(~many), order[first][several]])
    told = [*columns[:3], *(np.where(many, np.zeros(1, c.dtype), c) for c in columns[3:])]
    bucket = ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by = asked[np.argsort(bucket[asked], kind="stable")]
    parts = [(False, int(bucket[o[0]]), o, told) for o in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)]
    if many.any():
        parts.append((True, (base + len(order)) % buckets, np.flatnonzero(many), columns))
    for sure, to, o, cols in parts:
        row_ = ([to], [sure], [base], [_packed(kinds, [c[o] for c in cols])])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row_, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["bucket", "sure", "base", "blob"])


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with a number ``rid``: the place in their partition before the partition, so that numbers sorted lie close."""
    n = F.monotonically_increasing_id()
    part = F.shiftright(n, 33)
    place = F.shiftleft(n.bitwiseAND((1 << 33) - 1), 20)
    return df.withColumn("rid", F.when(part < 1 << 20, place + part).otherwise(F.raise_error(F.lit("over 2^20 partitions"))))


def _by_part(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows of a batch by numbers that are less than 2^32 apart, and the least number."""
    ids = b.column("rid").to_numpy()
    for part in np.unique(ids >> 32):
        mine = np.flatnonzero(ids >> 32 == part)
        yield (b if len(mine) == b.num_rows else b.take(pa.array(mine))), int(ids[mine].min())


def _ask(length: int, gram: int, buckets: int):
    """Packed names of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, base in _by_part(whole):
                a, edges = _texts(b.column("text"))
                at, n, pos, name = anchors(a, edges, length, gram)
                row = np.searchsorted(edges, at, side="right") - 1
                yield from _dealt(RUN, buckets, base, [name, b.column("rid").to_numpy()[row] - base, at - edges[row], n, pos - at])

    return run


SURVIVOR, SHARED = "rid long, gram long, place long", "rid long, p long, r1 long, r2 long"


def _stays(kinds: tuple, table: pa.Table) -> list[np.ndarray]:
    """Columns of a bucket's rows whose name more than one row has (``row`` as its number)."""
    parts = []
    for base, blob, known in zip(table.column("base").to_pylist(), table.column("blob"), table.column("sure").to_pylist()):
        name, row, *more = _unpacked(kinds, blob)
        parts.append([name, row.astype(np.int64) + base, *more, np.full(len(name), known)])
    *columns, known = (np.concatenate(x) for x in zip(*parts))
    name, rid = columns[:2]
    stays, order = known.copy(), np.flatnonzero(~known)
    if len(order):
        order = order[np.argsort(name[order], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
        several = np.minimum.reduceat(rid[order], first) < np.maximum.reduceat(rid[order], first)
        stays[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    stays &= columns[3] > 0  # not those that were only told
    return [c[stays] for c in columns]


def _runs_left(key: tuple, table: pa.Table) -> pa.Table:
    name, rid, at, n, off = _stays(RUN, table)
    place = at.astype(np.int64) << 16 | n.astype(np.int64) << 8 | off.astype(np.int64)
    return pa.table([pa.array(c) for c in (rid, name.view(np.int64), place)], names=["rid", "gram", "place"])


def _windows_left(key: tuple, table: pa.Table) -> pa.Table:
    name, rid, at, second = _stays(PAIR, table)
    return pa.table([pa.array(c) for c in (rid, at.astype(np.int64), name.view(np.int64), second.view(np.int64))], names=["rid", "p", "r1", "r2"])


def _listed(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The structs of a list column as arrays, and which row each belongs to."""
    lists = b.column(column)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(b.num_rows), counts), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


#: ``place``: a run's first window, how many it has (8 bits) and how far in the gram stands (8 bits).
RUNS = "rid long, doc long, gram long, seg long, l int, r int, place long"


def _runs(length: int, gram: int):
    """Names of whole runs, and of the gram's neighbours on either side (null where the text ends)."""
    x = (length - gram + 1) // 2
    y = length - gram - x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, edges = _texts(b.column("text"))
            row, f = _listed(b, "runs")
            s = edges[row] + (f["place"] >> 16)
            pos = s + (f["place"] & 255)
            low, high = pos - x, pos + gram + y
            no_left, no_right = low < edges[row], high > edges[row + 1]
            seg = named(a, s, s + (f["place"] >> 8 & 255) + length - 1)
            left = named(a, np.where(no_left, pos, low), pos)
            right = named(a, pos + gram, np.where(no_right, pos + gram, high))
            side = lambda v, null: pa.array((v >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=null)  # noqa: E731  half a name: it only drops
            cols = [pa.array(b.column("rid").to_numpy()[row]), pa.array(b.column("doc").to_numpy()[row]), pa.array(f["gram"]), pa.array(seg.view(np.int64)), side(left, no_left), side(right, no_right), pa.array(f["place"])]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc", "gram", "seg", "l", "r", "place"])

    return run


def _windows(length: int, buckets: int):
    """Packed pairs of names of each window of ranges ``f`` to ``t``; the first name has both, mixed."""
    half = (length + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, base in _by_part(whole):
                a, edges = _texts(b.column("text"))
                row, f = _listed(b, "ranges")
                n = f["t"] - f["f"]
                each = np.repeat(np.arange(len(n)), n)
                at = f["f"][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                row = row[each]
                p = edges[row] + at
                r1, r2 = named(a, p, p + half), named(a, p + length - half, p + length)
                yield from _dealt(PAIR, buckets, base, [_mixed(r1 * np.uint64(_BASE) + r2), b.column("rid").to_numpy()[row] - base, at, np.maximum(r2, np.uint64(1))])

    return run


CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed bytes, and the maximal runs that were removed."""
    for b in batches:
        a, edges = _texts(b.column("text"))
        row, f = _listed(b, "cuts")
        covered = np.zeros(len(a) + b.num_rows + 1, np.int32)  # one place more after each text, so that runs never touch
        shift = edges + np.arange(len(edges))
        np.add.at(covered, shift[row] + f["f"], 1)
        np.add.at(covered, shift[row] + f["t"], -1)
        gone = np.concatenate([[False], np.cumsum(covered) > 0])
        turn = np.flatnonzero(gone[1:] != gone[:-1])
        start, end = turn[::2], turn[1::2]
        of = np.searchsorted(shift, start, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(start - shift[of]), pa.array(end - shift[of])], names=["start", "end"])
        cuts = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)
        gone, kept = gone[1:], []
        for i in range(b.num_rows):
            text = a[edges[i] : edges[i + 1]]
            kept.append(text[~gone[shift[i] : shift[i] + len(text)]].tobytes() if cuts[i] < cuts[i + 1] else text.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(cuts), spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


@tidy
def dedup(docs: DataFrame, length: int = 50, gram: int = 24, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: texts without what documents of smaller ids repeat.

    ``spans`` are the maximal removed runs (byte offsets ``start, end``), ``kept`` the remaining
    bytes.  ``bucket_bytes``: about how much of the first round's names meets in one task.
    """
    if not 1 <= gram < length <= 256 or length - gram > 254:
        raise ValueError("1 <= gram < length <= 256")
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length("text").cast("long")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), text.alias("text")).withColumns({"n_bytes": size, "same": F.unhex(F.sha2("text", 256))})
    rows = settle(_numbered(given), "rid")  # texts meet runs, ranges and cuts where they lie
    same = rows.where(F.col("n_bytes") >= length).select("rid", "doc", "same")
    copied = settle(same.join(same.groupBy("same").agg(F.min("doc").alias("first")), "same").where("doc > first").select("rid"))
    kept = rows.join(copied, "rid", "left_anti")  # the text of a copy is not needed again
    of = kept.where(F.col("n_bytes") >= length).select("rid", "doc", "text")
    total = kept.where(F.col("n_bytes") >= length).agg(F.sum("n_bytes")).first()[0] or 0
    parts = lambda n, width: max(1, math.ceil(n * width / bucket_bytes))
    listed = lambda df, name, *cols: df.groupBy("rid").agg(F.collect_list(F.struct(*cols)).alias(name))  # noqa: E731  as many as a text's windows

    asked = of.select("rid", "text").mapInArrow(_ask(length, gram, parts(total * 2 / (length - gram + 2), 18)), QUESTION)
    left = settle(asked.groupBy("bucket").applyInArrow(_runs_left, SURVIVOR))
    runs = settle(of.join(listed(left, "runs", "gram", "place"), "rid").mapInArrow(_runs(length, gram), RUNS))
    forget(left)
    ranks = runs.groupBy("gram", "seg").agg(F.min("doc").alias("first"))
    ranked = runs.join(ranks, ["gram", "seg"]).withColumn("repeats", F.col("doc") > F.col("first"))
    compared = [F.when(~F.col("repeats"), F.col(c)).alias(c) for c in ("doc", "gram", "l", "r")]
    ranked = settle(ranked.select("rid", "place", "repeats", *compared))
    forget(runs)
    start, n, off = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    span = lambda f, t: (F.col("rid"), f.cast("int").alias("f"), t.cast("int").alias("t"))
    whole = settle(ranked.where("repeats").select(*span(start, start + n + length - 1)))

    firsts = ranked.where("not repeats")
    several = firsts.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")  # a gram with one rank is done
    once = firsts.join(several, "gram")
    shared = lambda side: once.where(F.col(side).isNotNull()).groupBy("gram", side).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("gram", side, F.lit(True).alias(f"more_{side}"))
    sided = once.join(shared("l"), ["gram", "l"], "left").join(shared("r"), ["gram", "r"], "left").where("more_l or more_r")
    mid, end = start + off - (length - gram + 1) // 2, start + n
    low = F.when(F.col("more_l"), start).otherwise(F.greatest(start, mid))
    high = F.when(F.col("more_r"), end).otherwise(F.least(end, mid + 1))
    ranges = settle(sided.select(*span(low, high)).where("f < t"))
    forget(ranked)
    windows = ranges.agg(F.sum(F.col("t") - F.col("f"))).first()[0] or 0
    asked = of.select("rid", "text").join(listed(ranges, "ranges", "f", "t"), "rid").mapInArrow(_windows(length, parts(windows, 24)), QUESTION)
    left = settle(asked.groupBy("bucket").applyInArrow(_windows_left, SHARED).join(of.select("rid", "doc"), "rid"))
    last = left.groupBy("r1", "r2").agg(F.min("doc").alias("first"))
    single = left.join(last, ["r1", "r2"]).where("doc > first").select(*span(F.col("p"), F.col("p") + length))

    cuts = settle(listed(whole.unionByName(single), "cuts", "f", "t"))
    forget(whole, ranges, left)
    none = F.array().cast("array<struct<f:int,t:int>>")
    whole_texts = kept.join(cuts, "rid", "left").select("doc_id", "text", F.coalesce("cuts", none).alias("cuts"))
    span_of_all = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    copies = rows.join(copied, "rid", "left_semi").select("doc_id", "n_bytes", span_of_all.alias("spans"), F.lit(b"").alias("kept"))
    return whole_texts.mapInArrow(_cut, CUT).unionByName(copies)


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the result of ``dedup``."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

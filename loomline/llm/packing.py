"""Best-fit packing into fixed-length sequences, by hierarchical residual packing.

1. Each partition tokenises its texts, cuts those longer than a sequence, and packs the
   pieces best-fit (longest first).  No shuffle.
2. Nearly full bins are final.  Underfull bins are dealt into groups of at most about
   ``group_bins`` and packed best-fit again as whole items.
3. Step 2 repeats with as few groups as their bounds allow, dealt anew (a tree of merges),
   until one group saw all or two rounds in a row saved no bin.

A bin is one row and holds at most ``seq_len`` members, and a group is bounded in bins and in
members, so every row and every task is bounded.  Pieces of one length are taken in the order
they come.  Very long texts are cut into pieces, whole.  Null text counts as empty: it is one piece that holds just the end id.  Repeated
rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MEMBER = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = f"size long, members array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>"
_MEMBER_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: Words of letters below U+0100 alone, in UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    ASCII white space always ends a token of these tokenizers, and they ignore case, so each
    distinct lower-case word is looked up after its first use.  A full stop or comma after a
    letter is a token of its own, so only the word before it is ever encoded.  Texts that may
    hold special tokens keep their case.  The cache is bounded.
    """

    def __init__(self, path: str, most: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.cache, self.most = Tokenizer.from_file(path), {}, most
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: set[bytes]) -> None:
        cache, cores, ends = self.cache, [], []
        for w in words:
            if len(w) > 1 and w[-1] in b".," and w[-2] in _LETTERS:
                ends.append(w)
                cores += [x for x in (w[:-1], w[-1:]) if x not in cache]
            else:
                cores.append(w)
        plain, other = [], []
        for w in dict.fromkeys(cores):
            (plain if _PLAIN.fullmatch(w) else other).append(w)
        if plain:  # each is one word to the tokenizer, so its last id is the next that ends a word
            ids = np.asarray(self.tok.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            for w, stop in zip(plain, stops, strict=True):
                cache[w] = raw[at:stop]
                at = stop
        for w, e in zip(other, self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)):
            cache[w] = np.asarray(e.ids, "<u4").tobytes()
        for w in ends:
            cache[w] = cache[w[:-1]] + cache[w[-1:]]

    def __call__(self, text: str) -> bytes:
        raw, cache = text.encode("utf-8", "surrogatepass"), self.cache
        words = (raw if b"<|" in raw else raw.lower()).split()
        got = list(map(cache.get, words))
        if None in got:
            if len(cache) > self.most:
                cache.clear()
            self._learn({w for w in words if w not in cache})
            got = [cache[w] for w in words]
        return b"".join(got)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, into the fullest bin that still takes it."""
    by_left: list[list[int]] = [[] for _ in range(room + 1)]  # bins by room left
    lefts: list[int] = []  # sorted kinds of room left that have a bin
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = bisect_left(lefts, s)
        if at < len(lefts):
            left = lefts[at]
            b = by_left[left].pop()
            if not by_left[left]:
                del lefts[at]
            bins[b].append(i)
        else:
            left, b = room, len(bins)
            bins.append([i])
        if rest := left - s:
            if not by_left[rest]:
                insort(lefts, rest)
            by_left[rest].append(b)
    return bins


def _emit(bins: list[tuple[int, list[dict]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.list_(_MEMBER_ARROW))], names=["size", "members"])


def _pack_texts(path: str, end_id: int, seq_len: int, hold: int) -> Callable:
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(path), []

        def flush() -> Iterator[pa.RecordBatch]:
            packed = [(sum(held[i]["length"] for i in b), [held[i] for i in b]) for b in best_fit([m["length"] for m in held], seq_len)]
            held.clear()
            for k in range(0, len(packed), 2000):
                yield _emit(packed[k : k + 2000])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    held.append({"doc_id": doc, "piece": piece, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
                if len(held) >= hold:
                    yield from flush()
        yield from flush()

    return run


def _repack(seq_len: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        sizes, members = group.column("size").to_pylist(), group.column("members").to_pylist()
        packed = [(sum(sizes[i] for i in b), [m for i in b for m in members[i]]) for b in best_fit(sizes, seq_len)]
        return pa.Table.from_batches([_emit(packed)])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 4096, slack: int = 8, group_bins: int = 8192, group_members: int = 500_000, hold: int = 100_000) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``slack``: a bin with at most so many free places is final.  ``hold``: pieces that a
    partition packs at once.
    """
    open_bins = settle(docs.select("doc_id", "text").mapInArrow(_pack_texts(tokenizer, end_id, seq_len, hold), BIN))
    full = F.col("size") >= seq_len - slack
    out = open_bins.where(full)
    rest = open_bins.where(~full)
    totals = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
    needed = lambda bins, members: max(1, math.ceil(bins / group_bins), math.ceil(members / group_members))
    n, members = totals(rest)
    groups, level, idle = needed(n, members), 0, 0
    while n > 1:
        level += 1
        first = F.col("members")[0]
        g = F.pmod(F.xxhash64(F.lit(level), "size", first["doc_id"], first["piece"]), F.lit(groups))
        merged = settle(rest.groupBy(g.alias("g")).applyInArrow(_repack(seq_len), BIN))
        out, rest = out.unionByName(merged.where(full)), merged.where(~full)
        idle = idle + 1 if merged.count() == n else 0
        n, members = totals(rest)
        if groups == 1 or idle == 2:
            break
        groups = needed(n, members)
    out = out.unionByName(rest)
    out = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    before = F.aggregate(F.slice("members", 1, F.col("pos")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    return out.select("sequence_id", "members", F.posexplode("members").alias("pos", "m")).select("m.*", "sequence_id", before.alias("offset"))

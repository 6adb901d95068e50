"""Ranked lexical search with block-max pruning (Ding and Suel, 2011).

1. One pass over the texts makes a forward index: blocks of ``block_docs`` documents in the order
   of the table, each with the lengths of its documents and, by term, where and how often it is.
   Terms that no query has are only counted.
2. Document frequencies and lengths are added up over all blocks; they fix every weight.
3. For each block the greatest share of each term bounds what any of its documents can score
   for a query.
4. Blocks are taken in order of a query's bound: the best one first, then ``first`` more, then all
   whose bound still reaches the query's k-th best score so far.  A block with a lower bound is
   never scored; one with an equal bound is, as ties go by id.

Texts null or without a term are in no statistic and no result.  Rows without an id count as
documents and are ranked after those of equal score that have one.  Repeated rows of documents
count, and are ranked, one by one.  Queries without an id or a text take no part; of queries that
share an id the least text is asked.  Very long texts are read whole.  Empty tables give no rows.
Other columns are ignored.  Queries are taken in groups of at most ``group`` and one pass over the
texts for each, so that what a task knows of them is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tidy

_LAST = (1 << 63) - 1
_TERM = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _TERM else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of anything beyond ASCII, with only A-Z lower-cased."""
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Queries:
    """Queries as rows of a sparse matrix: each distinct term (a place in ``vocabulary``) and its repeats."""

    ids: np.ndarray
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: dict[bytes, int]


def parse(items: list[tuple[int, str]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    start, term, times = [0], [], []
    for _, text in items:
        found: dict[int, int] = {}
        for t in terms(text.encode("utf-8", "surrogatepass")):
            k = vocabulary.setdefault(t, len(vocabulary))
            found[k] = found.get(k, 0) + 1
        term += found.keys()
        times += found.values()
        start.append(len(term))
    return Queries(np.array([i for i, _ in items], np.int64), np.array(start), np.array(term, np.int64), np.array(times, np.int64), vocabulary)


BLOCK = "docs long, words long, ids binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def _index(vocabulary: dict[bytes, int], block_docs: int):
    """Blocks of the forward index; a task's last one may hold fewer documents."""

    def block(ids: list, lengths: list, found: list[np.ndarray]) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        key, count = np.unique(np.concatenate(found).astype(np.int64) << 32 | place, return_counts=True)
        term = key >> 32
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        row = [len(ids), sum(lengths), np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), term[first].astype(np.int32).tobytes(), np.append(first, len(term)).astype(np.int32).tobytes(), (key & 0xFFFFFFFF).astype(np.int32).tobytes(), count.astype(np.int32).tobytes()]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found = [], [], []
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()):
                words = terms(t or b"")
                if words:
                    ids.append(_LAST if i is None else i)
                    lengths.append(len(words))
                    found.append(np.fromiter((k for k in map(vocabulary.get, words) if k is not None), np.int64))
                    if len(ids) == block_docs:
                        yield block(ids, lengths, found)
                        ids, lengths, found = [], [], []
        if ids:
            yield block(ids, lengths, found)

    return run


def _column(b: pa.RecordBatch, name: str, r: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b.column(name)[r].as_buffer(), kind)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a block each term is."""
    for b in batches:
        for r in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(_column(b, "terms", r).astype(np.int64)), pa.array(np.diff(_column(b, "starts", r)).astype(np.int64))], names=["term", "df"])


@dataclass(frozen=True)
class Weighted:
    """Queries with the weights of their terms, and the statistics that lengths are measured by."""

    queries: Queries
    weight: np.ndarray
    docs: int
    words: int

    def shares(self, b: pa.RecordBatch, r: int) -> np.ndarray:
        """What each posting of a block adds for weight 1."""
        m = 25 + (75 * _column(b, "lengths", r, np.int64) * self.docs) // self.words
        tf = _column(b, "counts", r).astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m[_column(b, "places", r)])


def _bounds(w: Weighted):
    """What a document of a block may score at most, for each query that shares a term with it."""
    q = w.queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                best = np.zeros(len(w.weight), np.int64)
                starts = _column(b, "starts", r)
                if len(starts) > 1:
                    best[_column(b, "terms", r)] = np.maximum.reduceat(w.shares(b, r), starts[:-1])
                total = np.concatenate([[0], np.cumsum(w.weight[q.term] * q.times * best[q.term])])
                bound = total[q.start[1:]] - total[q.start[:-1]]
                at = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([b.column("block")[r].as_py()] * len(at), pa.int64()), pa.array(bound[at])], names=["query", "block", "bound"])

    return run


HIT = "query long, doc_id long, score long"


def _score(w: Weighted, k: int):
    """The k best documents of a block, for each query that asks it."""
    q = w.queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, starts, places, known, shares = _column(b, "ids", r, np.int64), _column(b, "starts", r), _column(b, "places", r), _column(b, "terms", r), w.shares(b, r)
                out: list[tuple[int, int, int]] = []
                for query in b.column("asks")[r].as_py():
                    score = np.zeros(len(ids), np.int64)
                    mine = slice(q.start[query], q.start[query + 1])
                    at = np.searchsorted(known, q.term[mine])
                    for t, a, times in zip(q.term[mine], at, q.times[mine]):
                        if a < len(known) and known[a] == t:
                            s = slice(starts[a], starts[a + 1])
                            score[places[s]] += w.weight[t] * times * shares[s]
                    hit = np.flatnonzero(score > 0)
                    if len(hit) > k:
                        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
                    hit = hit[np.lexsort((ids[hit], -score[hit]))][:k]
                    out += zip([query] * len(hit), ids[hit].tolist(), score[hit].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["query", "doc_id", "score"])

    return run


def _group(docs: DataFrame, items: list[tuple[int, str]], k: int, block_docs: int, first: int) -> DataFrame:
    spark = docs.sparkSession
    q = parse(items)
    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index(q.vocabulary, block_docs), BLOCK)
    index = settle(index.withColumn("block", F.monotonically_increasing_id()))
    n, words = index.agg(F.sum("docs"), F.sum("words")).first()
    df = np.zeros(len(q.vocabulary), np.int64)
    for r in index.select("terms", "starts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # a row for each term of the queries
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * (n or 0) + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    w = Weighted(q, weight, n or 0, max(1, words or 0))
    bounds = settle(index.select("block", "lengths", "terms", "starts", "places", "counts").mapInArrow(_bounds(w), "query long, block long, bound long"))

    def scored(asks: DataFrame) -> DataFrame:
        by_block = asks.groupBy("block").agg(F.collect_list("query").alias("asks"))  # at most a group's queries
        return index.join(by_block, "block").drop("block", "docs", "words").mapInArrow(_score(w, k), HIT)

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def left(hits: DataFrame, done: DataFrame) -> DataFrame:
        """Blocks not scored yet whose bound reaches the k-th best score."""
        floor = hits.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("query", "floor")
        return bounds.join(done, ["query", "block"], "left_anti").join(floor, "query", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(1)))

    asked = settle(bounds.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")))
    hits = settle(best(scored(asked)).drop("rank"))
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    more = settle(left(hits, asked).withColumn("turn", F.row_number().over(by_bound)).where(F.col("turn") <= first).select("query", "block"))
    hits = settle(best(hits.unionByName(scored(more))).drop("rank"))
    rest = left(hits, asked.select("query", "block").unionByName(more)).select("query", "block")
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(q.ids)], "query long, item_id long")
    found = best(hits.unionByName(scored(rest))).join(names, "query")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "score")


@tidy
def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_docs: int = 512, first: int = 16, group: int = 5000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best ``docs`` (``doc_id, text``) for each of ``queries`` (``item_id, text``)."""
    asked = settle(queries.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text")))
    groups = max(1, math.ceil(asked.count() / group * 1.5))
    out = None
    for g in range(groups):  # by hash: some two thirds of ``group`` each
        mine = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        found = _group(docs, [(r["item_id"], r["text"]) for r in mine.orderBy("item_id").toLocalIterator()], k, block_docs, first)
        out = found if out is None else out.unionByName(found)
    return out

"""Hash chains of event logs: each event's digest covers the one before it in its stream.

A stream's chain is a fold, so a stream goes to one task, sorted, and is read once with one
digest in hand; streams are many and go in parallel.  The ends of all streams are chained in a
second pass, by blocks, to one digest of the whole log.  Checking needs no fold: each stored
digest must follow from the stored one before it, so all links are checked at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = ""


def link(previous: Column, body: Column) -> Column:
    """An event's digest: of the digest before it and its own canonical text."""
    return F.sha2(F.concat(previous, F.lit("\n"), F.coalesce(body, F.lit(""))), 256)


def _fold(stream: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), START
        for b in batches:
            before, after = [], []
            for s, body in zip(b.column(stream).to_pylist(), b.column("body").to_pylist()):
                if s != now:
                    now, last = s, START
                before.append(last)
                last = hashlib.sha256(f"{last}\n{body or ''}".encode("utf-8", "surrogatepass")).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([b.column(stream), b.column(key), b.column("body"), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[stream, key, "body", "previous_event_hash", "event_hash"])

    return run


def chained(events: DataFrame, stream: str, order: list[str], key: str, body: Column) -> DataFrame:
    """``stream, key, body, previous_event_hash, event_hash`` of events in ``order`` (unique within a stream)."""
    e = events.select(stream, *dict.fromkeys([*order, key]), body.alias("body")).repartition(stream).sortWithinPartitions(stream, *order)
    kinds = dict(e.dtypes)
    return e.select(stream, key, "body").mapInArrow(_fold(stream, key), f"`{stream}` {kinds[stream]}, `{key}` {kinds[key]}, body string, previous_event_hash string, event_hash string")


def heads(chain: DataFrame, events: DataFrame, stream: str, order: list[str], key: str) -> DataFrame:
    """``stream, events, head``: how long each chain is and its last digest."""
    j = chain.select(stream, key, "event_hash").join(events.select(*dict.fromkeys([stream, key, *order])), [stream, key])
    return j.groupBy(stream).agg(F.count("*").alias("events"), F.max_by("event_hash", F.struct(*order)).alias("head"))


def root(ends: DataFrame, stream: str, block: int = 1024) -> str:
    """One digest of all streams: blocks of sorted stream digests are hashed, then the blocks, until one is left."""
    from .packing import ranked

    level = ends.select(F.lit(0).alias("one"), F.col(stream).cast("string").alias("o"), F.sha2(F.concat_ws("\n", F.col(stream).cast("string"), "head"), 256).alias("h"))
    while True:
        r = ranked(level, ["one"], ["o"])
        g = r.groupBy("one", F.floor(F.col("rn") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("rn", "h"))).alias("l"))  # a block is bounded
        level = g.select("one", F.lpad(F.col("b").cast("string"), 20, "0").alias("o"), F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), "\n"), 256).alias("h"))
        few = level.select("h").limit(2).collect()
        if len(few) < 2:
            return few[0]["h"] if few else hashlib.sha256(b"").hexdigest()


def broken(chain: DataFrame, stream: str, order: list[str], key: str) -> DataFrame:
    """The first broken link of each stream of a stored chain: ``stream, key, violation_code``.

    LINK: an event does not name the digest before it (one was put in, taken out or moved);
    CONTENT: its digest is not that of what it holds.
    """
    w = Window.partitionBy(stream).orderBy(*order)
    c = chain.withColumn("before", F.coalesce(F.lag("event_hash").over(w), F.lit(START)))
    code = F.when(F.col("previous_event_hash") != F.col("before"), "LINK").when(link(F.col("previous_event_hash"), F.col("body")) != F.col("event_hash"), "CONTENT")
    bad = c.withColumn("violation_code", code).where("violation_code is not null")
    first = F.min(F.struct(*order, F.col(key).alias("_key"), "violation_code")).alias("f")
    return bad.groupBy(stream).agg(first).select(stream, F.col("f._key").alias(key), "f.violation_code")

"""Streaming forms of the event journals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts_by_type(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts with a watermark, for a stream or a batch."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is there into Parquet and stop."""
    q = df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def coalesced(deltas: DataFrame, key: list[str], order: str, column: str, least: int = 128, most: int = 4096) -> DataFrame:
    """Join small deltas of a generation: a piece ends at ``least`` characters or at a line break, and is split at ``most``; null deltas are empty."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t")))), lambda x: F.coalesce(x["t"], F.lit("")))
    split = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / most).cast("int")), lambda i: F.substring(t, i * most + 1, F.lit(most)))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(s, t):
        held = F.concat(s["held"], t)
        flush = (F.length(held) >= least) | F.contains(held, F.lit("\n"))
        return F.struct(F.when(flush, F.lit("")).otherwise(held).alias("held"), F.when(flush, F.concat(s["out"], split(held))).otherwise(s["out"]).alias("out"))

    fold = F.aggregate(seq, start, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], split(s["held"]))))
    return deltas.groupBy(*key).agg(fold.alias("p")).select(*key, F.posexplode("p").alias("ordinal", "piece"))


def resumed(events: DataFrame, key: str, order: str, after: int) -> DataFrame:
    """Events after a cursor."""
    return events.where(F.col(order) > after)


def dense(events: DataFrame, key: str, order: str) -> DataFrame:
    """Events out of sequence (must be empty)."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("want", F.row_number().over(w)).where(F.col(order) != F.col("want"))


def sequence_watch(events: DataFrame, key: str = "job_id", order: str = "sequence") -> DataFrame:
    """Events of a stream that are not the next of their job, with the number that was wanted: ``key, order, wanted``."""

    def watch(job: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for s in sorted(int(x) for b in batches for x in b[order]):
            if s != last + 1:
                yield pd.DataFrame({key: [job[0]], order: [s], "wanted": [last + 1]})
            last = max(last, s)
        state.update((last,))

    kind = dict(events.dtypes)[key]
    return events.select(key, order).groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, {order} long, wanted long", "last long", "append", GroupStateTimeout.NoTimeout)


def coalesced_live(events: DataFrame, least: int = 128, most: int = 4096) -> DataFrame:
    """``coalesced`` over a stream of journal events: ``generation_id, ordinal, piece``.

    What is held ends with the generation (COMPLETED or FAILED); until then it is the state,
    of less than ``least`` characters.
    """

    def step(generation: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ordinal = state.get if state.exists else ("", 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("sequence")
        for kind, text in zip(rows["kind"], rows["text"]):
            held += text or "" if kind == "DELTA" else ""
            if len(held) >= least or "\n" in held or (held and kind in ("COMPLETED", "FAILED")):
                out += [held[i : i + most] for i in range(0, len(held), most)]
                held = ""
        state.update((held, ordinal + len(out)))
        if out:
            yield pd.DataFrame({"generation_id": generation[0], "ordinal": range(ordinal, ordinal + len(out)), "piece": out})

    return events.select("generation_id", "sequence", "kind", "text").groupBy("generation_id").applyInPandasWithState(step, "generation_id string, ordinal long, piece string", "held string, ordinal long", "append", GroupStateTimeout.NoTimeout)

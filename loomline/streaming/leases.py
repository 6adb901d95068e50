"""Leases that go stale by themselves: state with timers over a live stream of heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "job_id string, status string, at timestamp"
ENDED = ("EXITED", "FAILED")


def lease_watch(beats: DataFrame, stale_after: int = 15, delay: str = "0 seconds") -> DataFrame:
    """Changes of each lease's status from a stream ``job_id, at, lifecycle``: HEALTHY, STALE, and EXITED or FAILED.

    A lease without a heartbeat for ``stale_after`` seconds of event time turns STALE by a timer,
    without an event of its own: as soon as the stream as a whole has gone on that far (``delay``
    is how late an event may come).  A later heartbeat makes it HEALTHY again.  An ended lease is
    forgotten, so what is held grows with the leases that live.  Older heartbeats change nothing.
    """
    late = stale_after * 1000
    stamp = lambda ms: pd.Timestamp(ms, unit="ms")

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last, stale = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((last, True))
            out.append((key[0], "STALE", stamp(last + late)))
        else:
            events = pd.concat(list(frames)).sort_values("at", kind="stable")
            for at, lifecycle in zip(events["at"], events["lifecycle"]):
                ms = int(at.timestamp() * 1000)
                if last is not None and ms < last:
                    continue
                if lifecycle in ENDED:
                    out.append((key[0], lifecycle, at))
                    last, stale = None, False
                    continue
                if last is not None and not stale and ms > last + late:
                    out.append((key[0], "STALE", stamp(last + late)))
                    stale = True
                if last is None or stale:
                    out.append((key[0], "HEALTHY", at))
                last, stale = ms, False
            if last is None:
                if state.exists:
                    state.remove()
            elif last + late <= state.getCurrentWatermarkMs():
                out.append((key[0], "STALE", stamp(last + late)))
                state.update((last, True))
            else:
                state.update((last, False))
                state.setTimeoutTimestamp(last + late)
        yield pd.DataFrame(out, columns=["job_id", "status", "at"])

    timed = beats.withWatermark("at", delay).groupBy("job_id")
    return timed.applyInPandasWithState(watch, STATUS, "last long, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)

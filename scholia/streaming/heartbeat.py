"""Services that send beats: who is there, who is late and who is gone, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Seconds without a beat after which a service is stale, and after which it is taken off.
STALE, REAPED = 90, 180

CHANGES = "service_type string, url string, change string, at timestamp"


class Beats(StatefulProcessor):
    """One service's state: its last beat and whether it is stale; timers stand where it would become stale or be taken off."""

    def __init__(self, stale: int = STALE, reaped: int = REAPED):
        self.after = {"stale": stale * 1000, "reaped": reaped * 1000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, stale boolean")

    def _change(self, key: tuple, change: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"service_type": [key[0]], "url": [key[1]], "change": [change], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, Spark's names
        beat = max(int(x) for batch in rows for x in batch["beat"])
        state = self.last.get() if self.last.exists() else None
        # a beat of before the last one says nothing new
        if state is not None and beat <= state[0]:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for wait in self.after.values():
            self.handle.registerTimer(beat + wait)
        self.last.update((beat, False))
        if state is None or state[1]:
            yield self._change(key, "registered" if state is None else "recovered", beat)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():
            return
        beat, _ = self.last.get()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if expired - beat >= self.after["reaped"]:
            self.last.clear()
            yield self._change(key, "reaped", expired)
        else:
            self.last.update((beat, True))
            yield self._change(key, "stale", expired)

    def close(self) -> None:
        pass


def changes(beats: DataFrame, late: str = "30 seconds", stale: int = STALE, reaped: int = REAPED) -> DataFrame:
    """The changes of a stream of beats (service_type, url, at): registered, stale, recovered, reaped.

    A service is registered by its first beat, and by the first after it was taken off.  It
    is late by the time of the events: the watermark is what has surely been seen.  Repeated
    beats, and such as come after a newer one, change nothing.  State is one row a service,
    and goes with it; it needs the RocksDB state store.
    """
    rows = beats.withWatermark("at", late).select("service_type", "url", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("beat"))
    return rows.groupBy("service_type", "url").transformWithStateInPandas(Beats(stale, reaped), StructType.fromDDL(CHANGES), "Append", "EventTime")

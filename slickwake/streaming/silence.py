"""Alerts for vessels that go silent, in steps, and when they are heard again: arbitrary state with several timers a vessel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERTS = "mmsi long, kind string, level_min double, since_ms long, at_ms long, lat double, lon double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SilenceProcessor(StatefulProcessor):
    """State of a vessel: its last report, the levels of silence that were told since, and a timer for each level to come.

    A last timer forgets the vessel, so state goes away for vessels that don't come back.
    """

    def __init__(self, levels_min: tuple[float, ...], forget_min: float):
        self.levels = sorted(int(m * 60_000) for m in levels_min)
        self.forget = int(forget_min * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, lat double, lon double")
        self.told = handle.getListState("told", "level_ms long")

    def _set_timers(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for level in (*self.levels, self.forget):
            self.handle.registerTimer(at + level)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.assign(at=batch["event_time"].astype("datetime64[ms]").astype("int64")).sort_values(["at", "lat", "lon"])
        last = self.last.get() if self.last.exists() else None
        told = [r[0] for r in self.told.get()] if self.told.exists() else []
        out = []
        before = last
        for at, lat, lon in batch[["at", "lat", "lon"]].itertuples(index=False):
            # what arrives behind the last report changes nothing
            if before is not None and at <= before[0]:
                continue
            if before is not None:
                # a silence may begin and end before any timer could run
                due = [level for level in self.levels if at - before[0] >= level]
                out += [(key[0], "SILENT", level / 60_000, before[0], before[0] + level, before[1], before[2]) for level in due if level not in told]
                if (due or told) and at - before[0] < self.forget:
                    out.append((key[0], "HEARD", max([*due, *told]) / 60_000, before[0], at, lat, lon))
            before, told = (int(at), float(lat), float(lon)), []
        if before is not last:
            self.last.update(before)
            self.told.clear()
            self._set_timers(before[0])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, lat, lon = self.last.get()
        level = expiredTimerInfo.getExpiryTimeInMs() - at
        rows = []
        if level in self.levels:
            self.told.appendValue((level,))
            rows.append((key[0], "SILENT", level / 60_000, at, at + level, lat, lon))
        if level == self.forget:
            self.last.clear()
            self.told.clear()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALERTS.split(", ")])

    def close(self) -> None:
        pass


def silence_alerts(stream: DataFrame, levels_min: tuple[float, ...] = (60.0, 180.0, 720.0), forget_min: float = 10_080.0, late: str = "2 hours") -> DataFrame:
    """``mmsi, kind, level_min, since_ms, at_ms, lat, lon`` of ``mmsi, event_time, lat, lon``.

    For each silence a ``SILENT`` row for each level that it reaches, with where and since when, and a ``HEARD`` row when it
    ends within ``forget_min``, with the highest level reached; each of them once, however reports are dealt to batches and
    across restarts.  After ``forget_min`` (more than any level) a vessel starts anew.  State lies in RocksDB, which the session is set to.
    """
    if forget_min <= max(levels_min):
        raise ValueError("a vessel can't be forgotten before the last level of silence")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select("mmsi", "event_time", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("mmsi IS NOT NULL AND event_time IS NOT NULL")
    return rows.withWatermark("event_time", late).groupBy("mmsi").transformWithStateInPandas(SilenceProcessor(levels_min, forget_min), ALERTS, "append", "eventTime")

"""Streaming extensions (the batch model has none): binned means, gap sessions and alerts for vessels that go silent.

Late reports beyond the watermark are dropped.  All three keep state by vessel and bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slickwake.functions.stats import circular_mean


def binned(stream: DataFrame, minutes: int = 6, late: str = "2 hours") -> DataFrame:
    """Means of position and speed and the mean direction of each vessel and bin."""
    w = F.window("event_time", f"{minutes} minutes")
    return stream.withWatermark("event_time", late).groupBy("mmsi", w.alias("w")).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("sog").alias("sog"), circular_mean("cog").alias("cog"), F.count("*").alias("n"))


def gap_sessions(stream: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Segments between silences longer than ``gap``."""
    return stream.withWatermark("event_time", late).groupBy("mmsi", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n_fixes"))


def dark_alerts(stream: DataFrame, silent_minutes: float = 60.0, late: str = "2 hours") -> DataFrame:
    """One row when a vessel has sent nothing for ``silent_minutes`` of event time: when and where it was last heard."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, lat, lon = state.get
            state.remove()
            yield pd.DataFrame({"mmsi": [key[0]], "last_ms": [at], "lat": [lat], "lon": [lon]})
            return
        last = state.get if state.exists else None
        for pdf in batches:
            newest = pdf.loc[pdf["event_time"].idxmax()]
            at = int(newest["event_time"].value // 1_000_000) if newest["event_time"].tzinfo is None else int(newest["event_time"].timestamp() * 1000)
            if last is None or at > last[0]:
                last = (at, float(newest["lat"]), float(newest["lon"]))
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] + int(silent_minutes * 60_000), state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark("event_time", late).groupBy("mmsi").applyInPandasWithState(
        run, "mmsi long, last_ms long, lat double, lon double", "last_ms long, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)

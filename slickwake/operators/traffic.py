"""Traffic over an area: counts by several groupings at once, distinct vessels as mergeable sketches, and frames over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s

#: Registers of a sketch are 2 to this power; its relative standard error is about 1.04 / sqrt(registers).
LG_REGISTERS = 12


def cell(degrees: str, side: float) -> Column:
    return F.floor(F.col(degrees) / side)


def traffic_cube(reports: DataFrame, cell_deg: float = 0.5) -> DataFrame:
    """Reports, mean speed and extent of reports of ``vessel_type, lat, lon, ts, sog`` by type, cell and hour of day, by several
    groupings in one pass: ``level`` tells which columns are grouped out (bits of type, row, column, hour, highest first).
    """
    rows = reports.select("vessel_type", cell("lat", cell_deg).alias("cell_row"), cell("lon", cell_deg).alias("cell_col"), F.hour("ts").alias("hour"), "sog", "lat")
    names = ("vessel_type", "cell_row", "cell_col", "hour")
    c = {n: F.col(n) for n in names}
    sets = [[c["vessel_type"], c["cell_row"], c["cell_col"]], [c["vessel_type"], c["hour"]], [c["cell_row"], c["cell_col"]], [c["hour"]], []]
    return rows.groupingSets(sets, *c.values()).agg(
        F.grouping_id(*names).cast("int").alias("level"), F.count("*").alias("n_reports"), F.avg("sog").alias("sog"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def vessel_sketches(reports: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """``cell_row, cell_col, day, vessels``: a sketch of the distinct vessels of each cell and day (``day``: days since 1970).

    The table is small beside the reports, and its sketches can be united over any box and time without reading reports
    again.  Store it; rows of later days can be added.
    """
    day = F.floor(epoch_s("ts") / 86_400)
    return reports.groupBy(cell("lat", cell_deg).alias("cell_row"), cell("lon", cell_deg).alias("cell_col"), day.alias("day")).agg(F.hll_sketch_agg("mmsi", LG_REGISTERS).alias("vessels"))


def united(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """``*by, n_vessels``: estimated distinct vessels of united sketches."""
    return sketches.groupBy(*by).agg(F.round(F.hll_sketch_estimate(F.hll_union_agg("vessels"))).cast("long").alias("n_vessels"))


def vessels_within(sketches: DataFrame, bbox: tuple[float, float, float, float], days: tuple[int, int], cell_deg: float = 0.25) -> DataFrame:
    """One row: the estimated number of vessels in the cells that a box (lon_min, lat_min, lon_max, lat_max) touches, on whole
    days from the first to the last."""
    low = lambda x: F.floor(F.lit(x) / cell_deg)
    inside = F.col("cell_col").between(low(bbox[0]), low(bbox[2])) & F.col("cell_row").between(low(bbox[1]), low(bbox[3])) & F.col("day").between(*days)
    return united(sketches.where(inside))


def recent(reports: DataFrame, hours: float = 24.0, silent_min: float = 60.0) -> DataFrame:
    """``reports`` (``mmsi, es, sog``) with what their vessels did in the ``hours`` before each, by frames over time, not rows.

    ``recent_n, recent_sog, recent_sog_range`` of the reports in the frame, ``recent_gap_min``, the longest gap that ends in it, and
    ``recent_silence``, the share of the frame inside gaps of more than ``silent_min``; a gap counts as far as it lies inside.
    """
    order = Window.partitionBy("mmsi").orderBy("es")
    frame = order.rangeBetween(-int(hours * 3600), 0)
    last = F.lag("es").over(Window.partitionBy("mmsi").orderBy("es"))
    df = reports.withColumn("_last", last)
    gap = F.col("es") - F.col("_last")
    df = df.withColumn("_gap", gap).withColumn("_silent", F.when(gap > silent_min * 60, gap).otherwise(0.0))
    # of the frame's first gap, what lies before the frame
    begin = F.col("es") - hours * 3600
    first = F.first(F.struct("_last", "_silent")).over(frame)
    outside = F.when(first["_silent"] > 0, F.greatest(F.lit(0.0), begin - first["_last"])).otherwise(0.0)
    return df.select(
        *reports.columns,
        F.count("*").over(frame).alias("recent_n"),
        F.avg("sog").over(frame).alias("recent_sog"),
        (F.max("sog").over(frame) - F.min("sog").over(frame)).alias("recent_sog_range"),
        (F.max("_gap").over(frame) / 60).alias("recent_gap_min"),
        ((F.sum("_silent").over(frame) - outside) / (hours * 3600)).alias("recent_silence"),
    )

"""Surface currents and winds as long tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s, normalise_lon, utc_time
from slickwake.operators.drift import CURRENT, WIND, uniform_fields
from slickwake.operators.field import ForcingCoverageError, GridField
from slickwake.sources.csv_files import by_header
from slickwake.sources.sinks import write_table

NEEDED = ("date", "time_utc", "latitude", "longitude", "water_u_mps", "water_v_mps")


def read_current_csv(spark: SparkSession, path: str, pattern: str = "Day_*.csv", bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Files of (date, time, place, u, v) to ``t, lat, lon, u, v``; of repeated keys the first file's first row counts.

    ``path`` is a file or a folder.  Each file's columns are found by its own header; a folder in which any file has
    bottom currents is refused.  A box is widened by half a degree.
    """
    one = path if path.lower().endswith(".csv") else f"{path.rstrip('/')}/{pattern}"
    groups = by_header(spark, one)
    for g in groups:
        if any("bottom" in c.lower() for c in g.names):
            raise ForcingCoverageError(f"{g.files[0]} has bottom currents, which are no surface forcing")
        if missing := [c for c in NEEDED if c not in g.names]:
            raise KeyError(f"{g.files[0]} lacks {missing}")
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    df = reduce(DataFrame.unionByName, [g.rows.select(*NEEDED, "ord") for g in groups]).select(
        utc_time(F.concat_ws(" ", "date", "time_utc")).alias("ts"), number("latitude").alias("lat"), normalise_lon(number("longitude")).alias("lon"),
        number("water_u_mps").alias("u"), number("water_v_mps").alias("v"), "ord",
    ).na.drop(subset=["ts", "lat", "lon"])
    if bbox:
        df = df.where(F.col("lat").between(bbox[1] - 0.5, bbox[3] + 0.5) & F.col("lon").between(bbox[0] - 0.5, bbox[2] + 0.5))
    first = F.row_number().over(Window.partitionBy("ts", "lat", "lon").orderBy("ord"))
    df = df.withColumn("_r", first).where("_r = 1").select(epoch_s("ts").alias("t"), "lat", "lon", "u", "v")
    if df.isEmpty():
        raise ForcingCoverageError(f"{one} has no rows in the region")
    return df


def read_field_table(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A long table ``t, lat, lon, u, v`` in Parquet; a box is widened by half a degree."""
    df = spark.read.parquet(path)
    if any("bottom" in c.lower() for c in df.columns):
        raise ForcingCoverageError(f"{path} has bottom currents, which are no surface forcing")
    if missing := [c for c in ("t", "lat", "lon", "u", "v") if c not in df.columns]:
        raise KeyError(f"{path} lacks {missing}")
    df = df.select(*(F.col(c).cast("double").alias(c) for c in ("t", "lat", "lon", "u", "v"))).withColumn("lon", normalise_lon(F.col("lon")))
    if bbox:
        df = df.where(F.col("lat").between(bbox[1] - 0.5, bbox[3] + 0.5) & F.col("lon").between(bbox[0] - 0.5, bbox[2] + 0.5))
    return df


def read_current(spark: SparkSession, path: str, pattern: str = "Day_*.csv", bbox: tuple[float, float, float, float] | None = None, verified_surface: bool = False) -> DataFrame:
    """Surface currents by the kind of path: a ``.csv`` file, a ``.parquet`` table, else a folder of CSV files.

    Kinds that need a library of their own (``.nc``, ``.grib``) are refused; their readers hand over a long table.
    """
    if not verified_surface:
        warnings.warn(f"{path} is taken for surface currents; set verified_surface once that is certain", stacklevel=2)
    kind = path.rstrip("/").lower().rpartition("/")[2].rpartition(".")[2]
    if kind == "parquet":
        return read_field_table(spark, path, bbox)
    if kind in ("nc", "nc4", "grib", "grb", "grib2"):
        raise ValueError(f"{path}: read it elsewhere and give the table t, lat, lon, u, v")
    return read_current_csv(spark, path, pattern, bbox)


def build_forcing(spark: SparkSession, source: str, wind: DataFrame | None = None, current: DataFrame | None = None, *, steady_wind: tuple[float, float] = WIND, steady_current: tuple[float, float] = CURRENT):
    """(wind, current) fields for a simulation: ``uniform``, or ``tables`` of (t, lat, lon, u, v); a table that is lacking is uniform."""
    if source == "uniform":
        return uniform_fields(steady_wind, steady_current)
    if source == "tables":
        if wind is None and current is None:
            raise ValueError("tables of wind or current are needed")
        w, c = uniform_fields(steady_wind, steady_current)
        return GridField.of(wind) if wind is not None else w, GridField.of(current) if current is not None else c
    raise ValueError(f"unknown source of forcing: {source}")


def export_forcing(spark: SparkSession, forcing: tuple, bbox: tuple[float, float, float, float], t0_s: float, t1_s: float, folder: str, case_id: str, step_hours: float = 1.0, grid_deg: float = 0.1) -> dict[str, str]:
    """What an external engine is given: wind and current of a case, sampled and written as its tables ``wind_field`` and
    ``current_field``.

    The grid goes one step beyond the box, the times are whole hours around [t0, t1].  A field that covers the case but
    not the rounded hours counts there as at its first or last time; a field that doesn't cover the case is an error.
    """
    west, south, east, north = bbox
    wide = (west - grid_deg, south - grid_deg, east + grid_deg, north + grid_deg)
    begin, end = t0_s // 3600 * 3600, -(-t1_s // 3600) * 3600
    out = {}
    for name, f in zip(("wind_field", "current_field"), forcing, strict=True):
        held = ClampedField(f, t0_s, t1_s) if isinstance(f, GridField) else f
        out[name] = write_table(sampled_field(spark, wide, begin, end, grid_deg, step_hours * 3600, held), folder, name, case_id)
    return out


class ClampedField:
    """A gridded field that covers [t0, t1] (else an error), asked at times that may lie beyond its ends."""

    def __init__(self, field: GridField, t0_s: float, t1_s: float):
        first, last = float(field.axes[0][0]), float(field.axes[0][-1])
        if t0_s < first - 1 or t1_s > last + 1:
            raise ForcingCoverageError(f"time: [{t0_s}, {t1_s}] is not inside [{first}, {last}]")
        self.field, self.first, self.last = field, first, last

    def uv(self, lat, lon, es):
        return self.field.uv(lat, lon, es.clip(self.first, self.last))


def sampled_field(spark: SparkSession, bbox: tuple[float, float, float, float], t0_s: float, t1_s: float, step_deg: float, step_s: float, field) -> DataFrame:
    """A field at a regular grid and at regular times, as a long table: what an external engine would be given."""
    n = lambda a, b, d: int((b - a) / d + 1e-9) + 1
    t = spark.range(n(t0_s, t1_s, step_s)).select((F.col("id") * step_s + t0_s).alias("t"))
    la = spark.range(n(bbox[1], bbox[3], step_deg)).select((F.col("id") * step_deg + bbox[1]).alias("lat"))
    lo = spark.range(n(bbox[0], bbox[2], step_deg)).select((F.col("id") * step_deg + bbox[0]).alias("lon"))

    def run(batches):
        for p in batches:
            p["u"], p["v"] = field.uv(p["lat"].to_numpy(), p["lon"].to_numpy(), p["t"].to_numpy())
            yield p

    return t.crossJoin(F.broadcast(la)).crossJoin(F.broadcast(lo)).mapInPandas(run, "t double, lat double, lon double, u double, v double")

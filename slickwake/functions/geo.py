"""Directions, spherical steps and pixel grids as column expressions.

Bearings are degrees clockwise from north.  Wind is given by where it comes from, a current by where it goes; u is
eastward and v northward.  Times are seconds since 1970 of zone-less timestamps, whatever the session's zone is.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values of the data model
EARTH_RADIUS_M = 6_371_008.8
KM_PER_DEG = 111.195
FEATURE_M_PER_DEG = 111_320.0
KM_PER_NM = 1.852
MS_PER_KNOT = 0.514444

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def epoch_s(ts: str) -> Column:
    """Seconds since 1970 (DOUBLE) of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})") / F.lit(1e6)


def from_epoch_s(seconds) -> Column:
    """A TIMESTAMP_NTZ, rounded to microseconds."""
    return F.timestamp_add("MICROSECOND", F.round(col(seconds) * 1e6).cast("long"), F.expr(_EPOCH))


def utc_time(text) -> Column:
    """Text to TIMESTAMP_NTZ in UTC, null if it is no time.  A zone or an offset counts; without one, the time is UTC."""
    s = F.trim(col(text).cast("string"))
    zoned = s.rlike(r"\d[Tt ]\d{1,2}:.*([Zz]|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)$")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(s.try_cast("timestamp")), F.expr(_EPOCH))
    return F.when(zoned, instant).otherwise(s.try_cast("timestamp_ntz"))


def met_wind_to_uv(speed, from_deg) -> tuple[Column, Column]:
    a = F.radians(col(from_deg))
    return -col(speed) * F.sin(a), -col(speed) * F.cos(a)


def current_to_uv(speed, to_deg) -> tuple[Column, Column]:
    a = F.radians(col(to_deg))
    return col(speed) * F.sin(a), col(speed) * F.cos(a)


def uv_to_speed_dir_to(u, v) -> tuple[Column, Column]:
    return F.hypot(col(u), col(v)), F.pmod(F.degrees(F.atan2(col(u), col(v))), F.lit(360.0))


def uv_to_speed_dir_from(u, v) -> tuple[Column, Column]:
    speed, to = uv_to_speed_dir_to(u, v)
    return speed, F.pmod(to + 180.0, F.lit(360.0))


def rotate_uv(u, v, clockwise_deg) -> tuple[Column, Column]:
    a = F.radians(col(clockwise_deg))
    return col(u) * F.cos(a) + col(v) * F.sin(a), -col(u) * F.sin(a) + col(v) * F.cos(a)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi, dlam = p2 - p1, F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlam / 2), 2)
    # least() and greatest() skip nulls, so an unknown end must stay unknown
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M / 1000 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def advect(lon, lat, u, v, seconds) -> tuple[Column, Column]:
    """One spherical step; the parallel is that of the start point."""
    c = F.greatest(F.cos(F.radians(col(lat))), F.lit(1e-6))
    return col(lon) + F.degrees(col(u) * col(seconds) / (EARTH_RADIUS_M * c)), col(lat) + F.degrees(col(v) * col(seconds) / EARTH_RADIUS_M)


def offset_m(lon, lat, east_m, north_m) -> tuple[Column, Column]:
    return advect(lon, lat, east_m, north_m, 1.0)


def destination(lon, lat, bearing_deg, distance_km) -> tuple[Column, Column]:
    a = F.radians(col(bearing_deg))
    return offset_m(lon, lat, col(distance_km) * 1000 * F.sin(a), col(distance_km) * 1000 * F.cos(a))


def local_km(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    k = EARTH_RADIUS_M / 1000 * pi / 180
    return (col(lon) - col(lon0)) * F.cos(F.radians(col(lat0))) * k, (col(lat) - col(lat0)) * k


def normalise_lon(lon) -> Column:
    return F.when(col(lon) > 180, col(lon) - 360).otherwise(col(lon))


def pixel_to_lonlat(row, c, west, north, pixel_deg) -> tuple[Column, Column]:
    """Centre of a pixel of a north-up grid."""
    return col(west) + (col(c) + 0.5) * col(pixel_deg), col(north) - (col(row) + 0.5) * col(pixel_deg)


def lonlat_to_pixel(lon, lat, west, north, pixel_deg) -> tuple[Column, Column]:
    """Fractional (row, column) whose integers are pixel centres."""
    return (col(north) - col(lat)) / col(pixel_deg) - 0.5, (col(lon) - col(west)) / col(pixel_deg) - 0.5


def register_sql(spark: SparkSession) -> None:
    """The same as temporary SQL functions, which Catalyst expands in place."""
    r = EARTH_RADIUS_M
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN
        {2 * r / 1000} * asin(sqrt(least(1D, greatest(0D, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))))""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wind_u(speed DOUBLE, from_deg DOUBLE) RETURNS DOUBLE RETURN -speed * sin(radians(from_deg))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wind_v(speed DOUBLE, from_deg DOUBLE) RETURNS DOUBLE RETURN -speed * cos(radians(from_deg))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bearing_to(u DOUBLE, v DOUBLE) RETURNS DOUBLE RETURN pmod(degrees(atan2(u, v)), 360D)")

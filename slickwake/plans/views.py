"""The driver's star-schema tables read as vessel reports, particles, pixels and fields.

Each view exists twice: as a DataFrame and as a DuckDB common table expression, with the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Thresholds for reports that are hours apart.
LONGEST_GAP_MIN, TOP_SPEED_KN, EVERY_MIN, FEWEST_FIXES, REACH, HISTORY, FOLDS, TOP_N = 1440.0, 50.0, 360, 4, 3, 4, 4, 8
HOURS = 144.0
STEPS, DT_S = 48, 10_800.0
T_OBS_S = 1_705_708_800.0  # 2024-01-20 00:00
OBS = {"center_lon": 32.62, "center_lat": 31.62, "major_km": 6.0, "minor_km": 2.0, "area_km2": 9.0, "pixel_km2": 0.0225}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HOURS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3.6e9D"


def dirty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with teleports, null islands, wide courses and repeated times."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("h", F.expr(_HOURS))
    base = e.selectExpr(
        "200000000 + user_id AS mmsi",
        "ts",
        "CASE WHEN event_id % 97 = 0 THEN 0D ELSE 31D + 0.02D * (user_id % 50) + 0.0002D * ((user_id % 7) - 3) * h + 0.0005D * (event_id % 11) + (CASE WHEN event_id % 101 = 0 THEN 20D ELSE 0D END) END AS lat",
        "CASE WHEN event_id % 97 = 0 THEN 0D ELSE 32D + 0.02D * (user_id % 40) + 0.0003D * ((user_id % 5) - 2) * h + 0.0005D * (event_id % 13) END AS lon",
        "value / 10D AS sog",
        "CAST((event_id * 37) % 720 - 180 AS DOUBLE) AS cog",
        "concat('V', CAST(user_id AS STRING)) AS vessel_name",
        "event_type AS vessel_type",
        "event_id AS ord",
    )
    again = base.where("ord % 50 = 0").withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("lat", F.col("lat") + 0.001)
    return base.union(again)


DIRTY_SQL = """base AS (
  SELECT 200000000 + user_id AS mmsi, ts,
    CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE 31.0::DOUBLE + 0.02::DOUBLE * (user_id % 50) + 0.0002::DOUBLE * ((user_id % 7) - 3) * h + 0.0005::DOUBLE * (event_id % 11) + (CASE WHEN event_id % 101 = 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END) END AS lat,
    CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE 32.0::DOUBLE + 0.02::DOUBLE * (user_id % 40) + 0.0003::DOUBLE * ((user_id % 5) - 2) * h + 0.0005::DOUBLE * (event_id % 13) END AS lon,
    value / 10.0::DOUBLE AS sog, CAST((event_id * 37) % 720 - 180 AS DOUBLE) AS cog,
    concat('V', user_id) AS vessel_name, event_type AS vessel_type, event_id AS ord
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS h FROM events)
), raw AS (
  SELECT * FROM base UNION ALL
  SELECT mmsi, ts, lat + 0.001, lon, sog, cog, vessel_name, vessel_type, ord + 1000000000 FROM base WHERE ord % 50 = 0
)"""


def transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean reports spread over a wider sea, for ranking."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("h", F.expr(_HOURS))
    return e.selectExpr(
        "200000000 + user_id AS mmsi",
        "ts",
        "31D + 0.08D * (user_id % 50) + 0.0002D * ((user_id % 7) - 3) * h + 0.0005D * (event_id % 11) AS lat",
        "32D + 0.08D * (user_id % 40) + 0.0003D * ((user_id % 5) - 2) * h + 0.0005D * (event_id % 13) AS lon",
        "value / 50D AS sog",
        "CAST((event_id * 37) % 360 AS DOUBLE) AS cog",
        "concat('V', CAST(user_id AS STRING)) AS vessel_name",
        "'cargo' AS vessel_type",
        "event_id AS ord",
    )


TRANSITS_SQL = """fixes AS (
  SELECT 200000000 + user_id AS mmsi, epoch_us(ts) / 1e6::DOUBLE AS es,
    31.0::DOUBLE + 0.08::DOUBLE * (user_id % 50) + 0.0002::DOUBLE * ((user_id % 7) - 3) * h + 0.0005::DOUBLE * (event_id % 11) AS lat,
    32.0::DOUBLE + 0.08::DOUBLE * (user_id % 40) + 0.0003::DOUBLE * ((user_id % 5) - 2) * h + 0.0005::DOUBLE * (event_id % 13) AS lon,
    value / 50.0::DOUBLE AS sog, concat('V', user_id) AS vessel_name
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS h FROM events)
)"""


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS particle",
        "32.6D + 0.002D * (p_partkey % 25) AS lon0",
        "31.6D + 0.002D * (p_partkey % 19) AS lat0",
        "0.01D + 0.03D * ((p_partkey * 7919) % 1000) / 1000 AS windage",
    )


_R = "6371008.8::DOUBLE"
#: Closed form of the uniform drift: latitude is linear in k, longitude a running sum.
PATHS_SQL = f"""parts AS (
  SELECT p_partkey AS particle, 32.6::DOUBLE + 0.002::DOUBLE * (p_partkey % 25) AS lon0, 31.6::DOUBLE + 0.002::DOUBLE * (p_partkey % 19) AS lat0,
    0.01::DOUBLE + 0.03::DOUBLE * ((p_partkey * 7919) % 1000) / 1000 AS windage FROM part
), vel AS (
  SELECT *, 0.15::DOUBLE * sin(radians(70)) + windage * (-5.0::DOUBLE * sin(radians(315))) AS u, 0.15::DOUBLE * cos(radians(70)) + windage * (-5.0::DOUBLE * cos(radians(315))) AS v FROM parts
), lats AS (
  SELECT particle, k, lon0, u, lat0 + k * degrees(v * -{DT_S} / {_R}) AS lat FROM vel, (SELECT unnest(range(0, {STEPS + 1})) AS k)
), paths AS (
  SELECT particle, k, {T_OBS_S} - k * {DT_S} AS es, lat,
    lon0 + coalesce(sum(degrees(u * -{DT_S} / ({_R} * greatest(cos(radians(lat)), 1e-6)))) OVER (PARTITION BY particle ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lon
  FROM lats
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 64 x 64 scenes; a pixel's value is a mean price, and two masks follow from arithmetic."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber % 2 AS scene_id", "CAST(l_orderkey % 64 AS INT) AS row", "CAST(l_partkey % 64 AS INT) AS col", "l_extendedprice AS p")
    return li.groupBy("scene_id", "row", "col").agg(F.avg("p").alias("value")).selectExpr(
        "scene_id", "row", "col", "value",
        "(row * 7 + col * 3 + scene_id) % 11 < 5 AS pred",
        "(row * 5 + col * 2) % 13 < 5 AS gt",
    )


PIXELS_SQL = """px AS (
  SELECT scene_id, "row", col, value, ("row" * 7 + col * 3 + scene_id) % 11 < 5 AS pred, ("row" * 5 + col * 2) % 13 < 5 AS gt
  FROM (SELECT l_linenumber % 2 AS scene_id, CAST(l_orderkey % 64 AS INT) AS "row", CAST(l_partkey % 64 AS INT) AS col, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)
)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scenes with one mask of wavy blobs (``mask``), for components and slick statistics."""
    return pixels(spark, sf_dir).selectExpr("scene_id", "row", "col", "value", "gt", "(abs((row * row + 3 * col + 5 * scene_id) % 41 - 20) < 9) AND (floor(row / 8) + floor(col / 8)) % 3 < 2 AS mask")


BLOBS_SQL = PIXELS_SQL + """, bl AS (
  SELECT scene_id, "row", col, value, gt, (abs(("row" * "row" + 3 * col + 5 * scene_id) % 41 - 20) < 9) AND (("row" // 8) + (col // 8)) % 3 < 2 AS mask FROM px
)"""


#: Cells of the field: 36 hours by 0.2 degrees, numbered by arithmetic; land around a place that moves with time.
FIELD_T0, FIELD_DT = 1_704_067_200, 129_600
_SEA = "(b - 11) * (b - 11) + (c - 9 - a % 10) * (c - 9 - a % 10) > 16"


def current_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of events by cell as a field ``t, lat, lon, u, v``; cells of land, and those that no event fell into, are missing."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", f"CAST(floor({_HOURS} / 36) AS BIGINT) AS a", "(user_id * 3 + event_id) % 23 AS b", "(event_id * 5 + user_id) % 29 AS c")
    return e.where(_SEA).groupBy("a", "b", "c").agg(F.avg("value").alias("x"), F.avg(F.expr("CAST((event_id * 37) % 360 AS DOUBLE)")).alias("y")).selectExpr(
        f"CAST({FIELD_T0} + a * {FIELD_DT} AS DOUBLE) AS t", "30D + 0.2D * b AS lat", "31D + 0.2D * c AS lon", "x / 400D - 0.1D AS u", "y / 720D - 0.25D AS v"
    )


FIELD_SQL = f"""known AS (
  SELECT CAST({FIELD_T0} + a * {FIELD_DT} AS DOUBLE) AS t, 30.0::DOUBLE + 0.2::DOUBLE * b AS lat, 31.0::DOUBLE + 0.2::DOUBLE * c AS lon, avg(value) / 400 - 0.1::DOUBLE AS u,
    avg(CAST((event_id * 37) % 360 AS DOUBLE)) / 720 - 0.25::DOUBLE AS v
  FROM (SELECT event_id, value, CAST(floor((epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE / 36) AS BIGINT) AS a, (user_id * 3 + event_id) % 23 AS b, (event_id * 5 + user_id) % 29 AS c FROM events)
  WHERE {_SEA} GROUP BY a, b, c
), ts AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i_t FROM (SELECT DISTINCT t FROM known)
), las AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS i_lat FROM (SELECT DISTINCT lat FROM known)
), los AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS i_lon FROM (SELECT DISTINCT lon FROM known)
), fld AS (
  SELECT i_t, i_lat, i_lon, t, lat, lon, u, v FROM (SELECT * FROM ts, las, los) LEFT JOIN known USING (t, lat, lon)
), filled AS (
  SELECT m.i_t, m.i_lat, m.i_lon, m.t, m.lat, m.lon, coalesce(m.u, n.u, 0) AS u, coalesce(m.v, n.v, 0) AS v
  FROM fld m LEFT JOIN (
    SELECT x.i_t, x.i_lat, x.i_lon, y.u, y.v, row_number() OVER (PARTITION BY x.i_t, x.i_lat, x.i_lon ORDER BY (x.i_lat - y.i_lat) ** 2 + (x.i_lon - y.i_lon) ** 2, y.i_lat, y.i_lon) AS r
    FROM fld x JOIN fld y ON x.i_t = y.i_t AND x.u IS NULL AND y.u IS NOT NULL
  ) n ON n.r = 1 AND m.i_t = n.i_t AND m.i_lat = n.i_lat AND m.i_lon = n.i_lon
)"""

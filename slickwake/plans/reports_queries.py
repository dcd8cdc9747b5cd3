"""Queries over vessel reports, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s
from slickwake.operators import ais, anomaly
from slickwake.plans import views
from slickwake.sources.scratch import stored
from slickwake.plans.views import DIRTY_SQL, EVERY_MIN, FEWEST_FIXES, FOLDS, HISTORY, LONGEST_GAP_MIN, REACH, TOP_SPEED_KN


def sql_round(x, digits: int) -> Column:
    """``round`` as the SQL counterparts do it: the product with a power of ten to the nearest integer, halves away from zero.

    Spark's ``round`` looks at the shortest decimal form instead, which falls on the other side of a half when the product does.
    """
    y = F.col(x) * float(10**digits)
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) == float("inf"), F.col(x)).otherwise(whole / float(10**digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns at a fixed number of digits: engines differ in the last bits."""
    return df.select(*(sql_round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)"
    return f"(CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(sqrt(least(1, greatest(0, {s})))) END)"


_SPEED = f"coalesce(CASE WHEN es > pes THEN {hav('plat', 'plon', 'lat', 'lon')} / ((es - pes) / 3600) / 1.852 END, 0)"
_LAG = "lag(es) OVER w AS pes, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon"
CLEAN_SQL = (
    DIRTY_SQL
    + f""", dd AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY ord) AS rn FROM raw
    WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)) WHERE rn = 1
), c0 AS (
  SELECT mmsi, ts, lat, lon, CASE WHEN sog IS NOT NULL THEN least(40, greatest(0, sog)) END AS sog, ((cog % 360) + 360) % 360 AS cog,
    vessel_name, vessel_type, ord, epoch_us(ts) / 1e6::DOUBLE AS es FROM dd
), cl AS (
  SELECT * EXCLUDE (pes, plat, plon) FROM (SELECT *, {_LAG} FROM c0 WINDOW w AS (PARTITION BY mmsi ORDER BY ts)) WHERE {_SPEED} <= 200
)"""
)
SEG_SQL = (
    CLEAN_SQL
    + f""", s1 AS (
  SELECT *, coalesce(es - pes, 0) / 60 AS gap_min, {_SPEED} AS kn FROM (SELECT *, {_LAG} FROM cl WINDOW w AS (PARTITION BY mmsi ORDER BY ts))
), sg AS (
  SELECT * EXCLUDE (b), sum(b) OVER (PARTITION BY mmsi ORDER BY ts ROWS UNBOUNDED PRECEDING) AS segment_id, CASE WHEN b = 1 THEN 0 ELSE gap_min END AS internal_gap_min
  FROM (SELECT *, CASE WHEN gap_min > {LONGEST_GAP_MIN} OR kn > {TOP_SPEED_KN} THEN 1 ELSE 0 END AS b FROM s1)
)"""
)
_STEP = EVERY_MIN * 60
BINS_SQL = (
    SEG_SQL
    + f""", s2 AS (
  SELECT *, floor(min(es) OVER (PARTITION BY mmsi, segment_id) / 86400) * 86400 AS day0 FROM sg QUALIFY count(*) OVER (PARTITION BY mmsi, segment_id) >= {FEWEST_FIXES}
), bins AS (
  SELECT mmsi, segment_id, day0, CAST(floor((es - day0) / {_STEP}) AS BIGINT) AS bin_no, avg(lat) AS lat, avg(lon) AS lon, avg(sog) AS sog,
    ((degrees(atan2(avg(sin(radians(cog))), avg(cos(radians(cog))))) % 360) + 360) % 360 AS cog, max(internal_gap_min) AS internal_gap_min, count(*) AS n_fixes,
    arg_min(vessel_name, es) AS vessel_name, arg_min(vessel_type, es) AS vessel_type, min(es) AS es0
  FROM s2 GROUP BY 1, 2, 3, 4
)"""
)


def _interp(c: str) -> str:
    """Independent of window frames: the neighbours are looked up by their numbers."""
    return f"""CASE WHEN g.{c} IS NOT NULL THEN g.{c} WHEN p_{c}.bin_no IS NULL OR g.bin_no - p_{c}.bin_no > {REACH} THEN NULL
      WHEN n_{c}.bin_no IS NULL THEN p_{c}.{c} ELSE p_{c}.{c} + (n_{c}.{c} - p_{c}.{c}) * (g.bin_no - p_{c}.bin_no) / (n_{c}.bin_no - p_{c}.bin_no) END AS {c}"""


_NEAR = " ".join(
    f"""ASOF LEFT JOIN (SELECT mmsi, segment_id, bin_no, {c} FROM bins WHERE {c} IS NOT NULL) {p}_{c} ON g.mmsi = {p}_{c}.mmsi AND g.segment_id = {p}_{c}.segment_id AND g.bin_no {op} {p}_{c}.bin_no"""
    for c in ("lat", "lon", "sog")
    for p, op in (("p", ">="), ("n", "<="))
)
FILL_SQL = (
    BINS_SQL
    + f""", ends AS (SELECT mmsi, segment_id, day0, min(bin_no) AS lo, max(bin_no) AS hi, arg_min(vessel_name, es0) AS vessel_name, arg_min(vessel_type, es0) AS vessel_type FROM bins GROUP BY 1, 2, 3
), grid AS (
  SELECT e.mmsi, e.segment_id, e.day0, e.vessel_name, e.vessel_type, e.bin_no, b.lat, b.lon, b.sog, b.cog, b.internal_gap_min
  FROM (SELECT *, unnest(range(lo, hi + 1)) AS bin_no FROM ends) e LEFT JOIN bins b ON e.mmsi = b.mmsi AND e.segment_id = b.segment_id AND e.bin_no = b.bin_no
), ip AS (
  SELECT g.mmsi, g.segment_id, g.day0, g.vessel_name, g.vessel_type, g.bin_no, g.cog, g.internal_gap_min, {_interp('lat')}, {_interp('lon')}, {_interp('sog')}
  FROM grid g {_NEAR}
), alive AS (
  SELECT * FROM ip WHERE lat IS NOT NULL AND lon IS NOT NULL AND sog IS NOT NULL QUALIFY count(*) OVER (PARTITION BY mmsi, segment_id) >= {HISTORY + 3}
), filled AS (
  SELECT mmsi, segment_id, day0 + bin_no * {_STEP} AS es, lat, lon, sog,
    coalesce(last_value(cog IGNORE NULLS) OVER (PARTITION BY mmsi, segment_id ORDER BY bin_no ROWS UNBOUNDED PRECEDING),
             first_value(cog IGNORE NULLS) OVER (PARTITION BY mmsi, segment_id ORDER BY bin_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cog,
    coalesce(internal_gap_min, 0) AS internal_gap_min, vessel_name, vessel_type FROM alive
)"""
)
FEAT_SQL = (
    FILL_SQL
    + """, feat AS (
  SELECT *, (lon - lon0) * 111320.0 * cos(radians(lat0)) AS east_m, (lat - lat0) * 111320.0 AS north_m, sin(radians(cog)) AS cog_sin, cos(radians(cog)) AS cog_cos,
    sin(2 * pi() * hod / 24) AS hod_sin, cos(2 * pi() * hod / 24) AS hod_cos
  FROM (SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, floor((es % 86400) / 60) / 60 AS hod FROM filled WINDOW w AS (PARTITION BY mmsi, segment_id ORDER BY es))
)"""
)
SEQ_SQL = (
    FEAT_SQL
    + f""", seqs AS (
  SELECT * FROM (SELECT *, row_number() OVER w - 1 AS t, lead(east_m) OVER w - 2 * east_m + lag(east_m) OVER w AS y1, lead(north_m) OVER w - 2 * north_m + lag(north_m) OVER w AS y2,
    sum(east_m) OVER (PARTITION BY mmsi, segment_id ORDER BY es ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING) AS x_sum FROM feat WINDOW w AS (PARTITION BY mmsi, segment_id ORDER BY es))
  WHERE t >= {HISTORY} AND y1 IS NOT NULL
)"""
)
JUMP_SQL = (
    FEAT_SQL
    + """, jp AS (
  SELECT *, coalesce(abs(sog - lag(sog) OVER w), 0) AS speed_jump, coalesce(CASE WHEN lag(cog) OVER w IS NOT NULL THEN least(abs(cog - lag(cog) OVER w), 360 - abs(cog - lag(cog) OVER w)) END, 0) AS course_jump
  FROM feat WINDOW w AS (PARTITION BY mmsi, segment_id ORDER BY es)
)"""
)
_Z = ("internal_gap_min", "speed_jump", "course_jump", "pred_error_m")
ROBUST_SQL = (
    JUMP_SQL
    + f""", er AS (
  SELECT j.*, coalesce(sqrt(s.y1 * s.y1 + s.y2 * s.y2), 0) AS pred_error_m
  FROM jp j LEFT JOIN (SELECT mmsi, segment_id, es, y1, y2 FROM (SELECT *, row_number() OVER w - 1 AS t, lead(east_m) OVER w - 2 * east_m + lag(east_m) OVER w AS y1, lead(north_m) OVER w - 2 * north_m + lag(north_m) OVER w AS y2 FROM feat WINDOW w AS (PARTITION BY mmsi, segment_id ORDER BY es)) WHERE t >= {HISTORY} AND y1 IS NOT NULL) s
  ON j.mmsi = s.mmsi AND j.segment_id = s.segment_id AND j.es = s.es
), vs AS (SELECT mmsi, row_number() OVER (ORDER BY ((mmsi % 1000003) * 7919 + 523645) % 1000003, mmsi) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT mmsi FROM er)
), fo AS (SELECT mmsi, CAST(r % greatest(2, least({FOLDS}, n)) AS INT) AS fold FROM vs
), fr AS (SELECT er.*, fo.fold FROM er JOIN fo USING (mmsi)
), tr AS (SELECT f.fold AS ff, fr.* FROM (SELECT DISTINCT fold FROM fo) f JOIN fr ON fr.fold <> f.fold
), md AS (SELECT ff, {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM tr GROUP BY ff
), ad AS (SELECT tr.ff, {', '.join(f'quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}' for c in _Z)} FROM tr JOIN md ON tr.ff = md.ff GROUP BY tr.ff
), zz AS (SELECT fr.*, {', '.join(f'({c} - m_{c}) / (CASE WHEN d_{c} > 1e-9 THEN d_{c} * 1.4826 WHEN s_{c} > 0 THEN s_{c} ELSE 1 END) AS z_{c}' for c in _Z)}
  FROM fr LEFT JOIN md ON fr.fold = md.ff LEFT JOIN ad ON fr.fold = ad.ff
)"""
)
POINT_SQL = (
    ROBUST_SQL
    + """, pt AS (
  SELECT *, greatest(z_internal_gap_min, 0) AS ais_quality_z, greatest(0.4 * z_speed_jump + 0.3 * z_course_jump + 0.3 * z_pred_error_m, 0) AS behavior_z FROM zz
), ps AS (SELECT *, 0.7 * behavior_z + (1 - 0.7) * ais_quality_z AS final_point_score FROM pt)"""
)


# ------------------------------------------------------------------ queries


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais.clean(views.dirty_reports(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais.segments(_clean(spark, sf_dir), longest_gap_min=LONGEST_GAP_MIN)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais.resample(_segments(spark, sf_dir), every_min=EVERY_MIN)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais.fill_gaps(_bins(spark, sf_dir), every_min=EVERY_MIN, fewest_bins=HISTORY + 3)


def _feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais.features(_filled(spark, sf_dir))


def ais_normalize(spark, sf_dir):
    """Reports of a box and a time range with required keys and default names."""
    df = views.dirty_reports(spark, sf_dir).where("mmsi IS NOT NULL AND ts IS NOT NULL AND lat BETWEEN 31 AND 33 AND lon BETWEEN 32 AND 34")
    df = df.where("ts BETWEEN TIMESTAMP_NTZ'2024-01-05 00:00:00' AND TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    return rounded(df.select("mmsi", "lat", "lon", "sog", F.coalesce("vessel_name", F.col("mmsi").cast("string")).alias("vessel_name"), F.coalesce("vessel_type", F.lit("unknown")).alias("vessel_type"), epoch_s("ts").alias("es"), "ord"))


def ais_clean(spark, sf_dir):
    return rounded(_clean(spark, sf_dir).select("mmsi", "es", "lat", "lon", "sog", "cog", "ord"))


def ais_segments(spark, sf_dir):
    return rounded(_segments(spark, sf_dir).select("mmsi", "es", "segment_id", "gap_min", "internal_gap_min"))


def segment_meta(spark, sf_dir):
    return ais.segment_meta(_segments(spark, sf_dir)).select("mmsi", "segment_id", "n_raw")


def ais_resample(spark, sf_dir):
    return rounded(_bins(spark, sf_dir).select("mmsi", "segment_id", "bin_no", "lat", "lon", "sog", "cog", "internal_gap_min", "n_fixes"))


def ais_gapfill(spark, sf_dir):
    return rounded(_filled(spark, sf_dir).select("mmsi", "segment_id", "es", "lat", "lon", "sog", "cog", "internal_gap_min", "vessel_name", "vessel_type"), 9)


def ais_features(spark, sf_dir):
    return rounded(_feat(spark, sf_dir).select("mmsi", "segment_id", "es", "east_m", "north_m", "cog_sin", "cog_cos", "hod_sin", "hod_cos"), 5)


def tracks(spark, sf_dir):
    return ais.tracks(_clean(spark, sf_dir)).groupBy("mmsi").agg(F.max("n_fixes").alias("n_fixes"), F.count("*").alias("n_rows"))


def sequence_targets(spark, sf_dir):
    s = anomaly.sequences(_feat(spark, sf_dir), HISTORY)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])
    return rounded(s.select("mmsi", "segment_id", "es", "t", "y1", "y2", "cv_error_m", F.size("x").cast("long").alias("n_history"), F.round(total / 1000, 2).alias("x_sum_km")), 4)


def behaviour_jumps(spark, sf_dir):
    return rounded(anomaly.jumps(_feat(spark, sf_dir)).select("mmsi", "segment_id", "es", "speed_jump", "course_jump"))


def _points(spark, sf_dir):
    f = stored(_feat(spark, sf_dir), "features")
    return anomaly.point_scores(f, anomaly.sequences(f, HISTORY).withColumnRenamed("cv_error_m", "pred_error_m"), FOLDS)


def robust_z_oof(spark, sf_dir):
    return rounded(_points(spark, sf_dir).select("mmsi", "segment_id", "es", "fold", *(f"z_{c}" for c in _Z)), 5)


def vessel_anomaly(spark, sf_dir):
    return rounded(anomaly.vessel_scores(_points(spark, sf_dir)).select("mmsi", "anomaly_raw", "anomaly_confidence", "n_points"), 5)


def gap_sessions_window(spark, sf_dir):
    """Segments by gaps alone, with Spark's session windows; a report exactly at the gap stays in its session."""
    df = _clean(spark, sf_dir)
    s = df.groupBy("mmsi", F.session_window("ts", "1440 minutes").alias("w")).agg(F.count("*").alias("n_fixes"), F.min("es").alias("first_es"), F.max("es").alias("last_es"))
    return s.select("mmsi", "n_fixes", "first_es", "last_es")


def hash_subsample(spark, sf_dir):
    """A fixed number of training rows without replacement: the smallest values of an arithmetic hash."""
    key = F.pmod(F.col("es").cast("long") * 31 + F.col("mmsi") * 17, F.lit(1_000_003))
    return anomaly.sequences(_feat(spark, sf_dir), HISTORY).select("mmsi", "segment_id", "es", key.alias("draw")).orderBy("draw", "mmsi", "es").limit(200)


def event_windows(spark, sf_dir):
    """Tumbling bins of all reports (the batch twin of the streaming query)."""
    df = views.dirty_reports(spark, sf_dir).withColumn("bin", F.floor(epoch_s("ts") / 3600))
    return rounded(df.groupBy("mmsi", "bin").agg(F.count("*").alias("n"), F.avg("sog").alias("sog"), F.max("lat").alias("lat_max")))


def oof_model(spark, sf_dir):
    """Motion residuals of vessels that a model hasn't seen (no SQL counterpart; held-out error in the tests)."""
    from slickwake.operators import models

    errors, _ = models.out_of_fold(anomaly.sequences(_feat(spark, sf_dir), HISTORY), models=("MLP",))
    return rounded(errors, 3)


QUERIES = {f.__name__: f for f in (
    ais_normalize, ais_clean, ais_segments, segment_meta, ais_resample, ais_gapfill, ais_features, tracks, sequence_targets, behaviour_jumps,
    robust_z_oof, vessel_anomaly, gap_sessions_window, hash_subsample, event_windows, oof_model)}

_r = lambda names, d=6: ", ".join(f"round({c}, {d}) AS {c}" for c in names.split())
SQL = {
    "ais_normalize": f"WITH {DIRTY_SQL} SELECT mmsi, {_r('lat lon sog')}, coalesce(vessel_name, CAST(mmsi AS VARCHAR)) AS vessel_name, coalesce(vessel_type, 'unknown') AS vessel_type, epoch_us(ts) / 1e6 AS es, ord FROM raw WHERE lat BETWEEN 31 AND 33 AND lon BETWEEN 32 AND 34 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "ais_clean": f"WITH {CLEAN_SQL} SELECT mmsi, {_r('es lat lon sog cog')}, ord FROM cl",
    "ais_segments": f"WITH {SEG_SQL} SELECT mmsi, segment_id, {_r('es gap_min internal_gap_min')} FROM sg",
    "segment_meta": f"WITH {SEG_SQL} SELECT mmsi, segment_id, count(*) AS n_raw FROM sg GROUP BY 1, 2",
    "ais_resample": f"WITH {BINS_SQL} SELECT mmsi, segment_id, bin_no, n_fixes, {_r('lat lon sog cog internal_gap_min')} FROM bins",
    "ais_gapfill": f"WITH {FILL_SQL} SELECT mmsi, segment_id, vessel_name, vessel_type, {_r('es lat lon sog cog internal_gap_min', 9)} FROM filled",
    "ais_features": f"WITH {FEAT_SQL} SELECT mmsi, segment_id, {_r('es east_m north_m cog_sin cog_cos hod_sin hod_cos', 5)} FROM feat",
    "tracks": f"WITH {CLEAN_SQL} SELECT mmsi, count(*) AS n_fixes, count(*) AS n_rows FROM cl GROUP BY 1 HAVING count(*) >= 2",
    "sequence_targets": f"WITH {SEQ_SQL} SELECT mmsi, segment_id, t, {_r('es y1 y2', 4)}, round(sqrt(y1 * y1 + y2 * y2), 4) AS cv_error_m, CAST({HISTORY} AS BIGINT) AS n_history, round(x_sum / 1000, 2) AS x_sum_km FROM seqs",
    "behaviour_jumps": f"WITH {JUMP_SQL} SELECT mmsi, segment_id, {_r('es speed_jump course_jump')} FROM jp",
    "robust_z_oof": f"WITH {ROBUST_SQL} SELECT mmsi, segment_id, fold, {_r('es ' + ' '.join(f'z_{c}' for c in _Z), 5)} FROM zz",
    "vessel_anomaly": f"WITH {POINT_SQL}, vv AS (SELECT mmsi, greatest(quantile_cont(final_point_score, 0.5), quantile_cont(final_point_score, 0.95)) AS raw_score, count(*) AS n_points FROM ps GROUP BY 1) SELECT mmsi, round(raw_score, 5) AS anomaly_raw, round(1 / (1 + exp(-(raw_score - 3))), 5) AS anomaly_confidence, n_points FROM vv",
    "gap_sessions_window": f"WITH {CLEAN_SQL}, gs AS (SELECT *, sum(b) OVER (PARTITION BY mmsi ORDER BY es ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN es - lag(es) OVER (PARTITION BY mmsi ORDER BY es) > 86400 THEN 1 ELSE 0 END AS b FROM cl)) SELECT mmsi, count(*) AS n_fixes, min(es) AS first_es, max(es) AS last_es FROM gs GROUP BY mmsi, s",
    "hash_subsample": f"WITH {SEQ_SQL} SELECT mmsi, segment_id, es, (CAST(es AS BIGINT) * 31 + mmsi * 17) % 1000003 AS draw FROM seqs ORDER BY draw, mmsi, es LIMIT 200",
    "event_windows": f"WITH {DIRTY_SQL} SELECT mmsi, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS bin, count(*) AS n, round(avg(sog), 6) AS sog, round(max(lat), 6) AS lat_max FROM raw GROUP BY 1, 2",
}

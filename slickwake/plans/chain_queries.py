"""The whole chain over given tables: real anomaly scores and forward runs in the ranking of leads, with the DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.functions.geo import EARTH_RADIUS_M, current_to_uv, epoch_s, haversine_km, met_wind_to_uv
from slickwake.operators import anomaly, attribution, drift, fusion, twin
from slickwake.plans import views
from slickwake.plans.drift_queries import _FUSE, _KM, _SPREAD, _paths
from slickwake.plans.reports_queries import POINT_SQL, _points, _r, hav, rounded
from slickwake.plans.views import DT_S, OBS, STEPS, T_OBS_S, TOP_N
from slickwake.sources.scratch import stored


def _scored_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stored(anomaly.vessel_scores(_points(spark, sf_dir)), "vessels")
    return stored(attribution.rank_vessels(views.transits(spark, sf_dir), drift.cloud_stats(_paths(spark, sf_dir)), T_OBS_S, DT_S, STEPS, scores), "funnel")


def forward_clouds(starts: DataFrame, particles: DataFrame) -> DataFrame:
    """Where particles of each candidate are at the observation: ``mmsi, lon, lat, drift_km`` of ``mmsi, lon0, lat0, steps``.

    In a uniform field a path has a closed form but for the parallels that it crosses, so each particle is one row and its
    steps are a sum inside the row.
    """
    wind, current = (tuple(F.lit(0.0) + x for x in f(*map(F.lit, w))) for f, w in ((met_wind_to_uv, drift.WIND), (current_to_uv, drift.CURRENT)))
    u, v = drift.oil_velocity(wind, current, "windage")
    both = starts.crossJoin(particles.select("windage")).withColumn("u", u).withColumn("v", v)  # starts: the top candidates
    rise = F.degrees(F.col("v") * DT_S / EARTH_RADIUS_M)
    east = lambda i: F.degrees(F.col("u") * DT_S / (EARTH_RADIUS_M * F.greatest(F.cos(F.radians(F.col("lat0") + i * rise)), F.lit(1e-6))))
    walked = F.aggregate(F.sequence(F.lit(0), F.col("steps") - 1), F.lit(0.0), lambda total, i: total + east(i))
    slick = haversine_km("lat0", "lon0", F.lit(OBS["center_lat"]), F.lit(OBS["center_lon"]))
    return both.select("mmsi", (F.col("lon0") + walked).alias("lon"), (F.col("lat0") + F.col("steps") * rise).alias("lat"), slick.alias("drift_km"))


def fuse_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking with anomaly scores of the vessels' own behaviour, and position evidence of forward runs of the top candidates."""
    funnel = _scored_funnel(spark, sf_dir)
    top = attribution.top_candidates(funnel, TOP_N)
    starts = top.select("mmsi", F.col("est_release_lon").alias("lon0"), F.col("est_release_lat").alias("lat0"), F.round((T_OBS_S - epoch_s("est_release_time")) / DT_S).cast("int").alias("steps"))
    seen = twin.position_evidence(forward_clouds(F.broadcast(starts), views.particles(spark, sf_dir)), OBS, F.col("drift_km"))
    fused = fusion.fuse(funnel, seen.select("mmsi", F.col("position_score").alias("digital_twin_score")))
    return rounded(fused.select("rank", "mmsi", "attribution_score", "anomaly_confidence", "digital_twin_score", "confidence", "evidence_flags"), 5)


QUERIES = {"fuse_scored": fuse_scored}

_STEP = f"{DT_S} / 6371008.8::DOUBLE"
_TWIN = f"""tstart AS (SELECT f.mmsi, est_release_lat AS la0, est_release_lon AS lo0, CAST(round(({T_OBS_S} - est_release_time) / {DT_S}) AS BIGINT) AS steps FROM funnel f JOIN topn ON f.mmsi = topn.mmsi
), tends AS (
  SELECT mmsi, particle, any_value(la0 + steps * degrees(v * {_STEP})) AS lat, any_value(lo0) + sum(degrees(u * {_STEP} / greatest(cos(radians(la0 + i * degrees(v * {_STEP}))), 1e-6))) AS lon, any_value({hav('la0', 'lo0', OBS['center_lat'], OBS['center_lon'])}) AS drift_km
  FROM tstart, vel, (SELECT unnest(range(0, {STEPS})) AS i) WHERE i < steps GROUP BY mmsi, particle
), tg AS (SELECT mmsi, avg(lon) AS clon, avg(lat) AS clat, {_SPREAD.format(k=_KM)} / sqrt(2) AS sigma, max(drift_km) AS drift_km FROM tends GROUP BY mmsi
), twin AS (
  SELECT mmsi, exp(-0.5 * power({hav('clat', 'clon', OBS['center_lat'], OBS['center_lon'])} / greatest(sqrt(sigma * sigma + {(max(OBS['major_km'], OBS['minor_km']) / 4) ** 2} + power(0.1 * drift_km, 2)), 1), 2)) AS twin_score FROM tg
)"""
_BEFORE, _AFTER = _FUSE.split("), fz AS (")
_BEFORE = _BEFORE.replace("ve.mmsi * 37 % 1000 / 1000.0::DOUBLE", "coalesce(vv.score, 0)").replace("LEFT JOIN ag ON ve.mmsi = ag.mmsi", "LEFT JOIN ag ON ve.mmsi = ag.mmsi LEFT JOIN vv ON ve.mmsi = vv.mmsi")
_AFTER = _AFTER.replace("CASE WHEN t.mmsi IS NULL THEN 0 ELSE f.mmsi * 53 % 1000 / 1000.0::DOUBLE END AS digital_twin_score FROM funnel f LEFT JOIN topn t", "coalesce(t.twin_score, 0) AS digital_twin_score FROM funnel f LEFT JOIN twin t")
_VESSELS = "vv AS (SELECT mmsi, 1 / (1 + exp(3 - greatest(quantile_cont(final_point_score, 0.5), quantile_cont(final_point_score, 0.95)))) AS score FROM ps GROUP BY 1)"
SQL = {
    "fuse_scored": f"WITH {POINT_SQL}, {_VESSELS}, {_BEFORE}), {_TWIN}, fz AS ({_AFTER} SELECT rank, mmsi, evidence_flags, {_r('attribution_score anomaly_confidence digital_twin_score confidence', 5)} FROM fu",
}

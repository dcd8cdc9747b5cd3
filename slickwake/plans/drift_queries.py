"""Queries over drifting clouds, attribution and fusion, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.functions import geo
from slickwake.operators import attribution, drift, field, fusion, twin
from slickwake.plans import views
from slickwake.sources.scratch import stored
from slickwake.plans.reports_queries import _r, hav, rounded
from slickwake.plans.views import DT_S, FIELD_SQL, HOURS, OBS, PATHS_SQL, STEPS, T_OBS_S, TOP_N, TRANSITS_SQL


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.uniform_paths(views.particles(spark, sf_dir), T_OBS_S, HOURS, dt_min=DT_S / 60)


def _winds(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr("event_id", "value / 10D AS speed", "CAST((event_id * 53) % 360 AS DOUBLE) AS deg")


def uv_roundtrip(spark, sf_dir):
    df = _winds(spark, sf_dir)
    u, v = geo.met_wind_to_uv("speed", "deg")
    cu, cv = geo.current_to_uv("speed", "deg")
    df = df.withColumns({"u": u, "v": v, "cu": cu, "cv": cv})
    back, came = geo.uv_to_speed_dir_from("u", "v")
    ru, rv = geo.rotate_uv("cu", "cv", 30.0)
    df = df.withColumns({"speed_back": back, "from_deg": F.pmod(F.round(came, 6), F.lit(360.0)), "ru": ru, "rv": rv})
    return rounded(df.select("event_id", "u", "v", "cu", "cv", "speed_back", "from_deg", "ru", "rv"))


def sphere_steps(spark, sf_dir):
    """Distances, destinations and local coordinates."""
    df = views.transits(spark, sf_dir).select("ord", "lat", "lon", "cog", "sog")
    x, y = geo.destination("lon", "lat", "cog", F.col("sog") + 1)
    df = df.withColumns({"lon2": x, "lat2": y})
    kx, ky = geo.local_km("lon2", "lat2", "lon", "lat")
    return rounded(df.withColumns({"km": geo.haversine_km("lat", "lon", "lat2", "lon2"), "x_km": kx, "y_km": ky}).select("ord", "lon2", "lat2", "km", "x_km", "y_km"), 5)


def pixel_grid(spark, sf_dir):
    """Pixel centres to longitude and latitude, and back."""
    df = views.pixels(spark, sf_dir).select("scene_id", "row", "col")
    lon, lat = geo.pixel_to_lonlat("row", "col", 32.0, 31.8, 0.0009)
    df = df.withColumns({"lon": lon, "lat": lat})
    r, c = geo.lonlat_to_pixel("lon", "lat", 32.0, 31.8, 0.0009)
    return df.select("scene_id", "row", "col", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(r).cast("long").alias("row2"), F.round(c).cast("long").alias("col2"))


def oil_velocities(spark, sf_dir):
    df = _winds(spark, sf_dir)
    u, v = drift.oil_velocity(geo.met_wind_to_uv("speed", "deg"), geo.current_to_uv(F.col("speed") / 20, F.col("deg") + 40), 0.03, 1.1, 10.0, 0.9, -5.0)
    return rounded(df.select("event_id", u.alias("u"), v.alias("v")))


def drift_uniform(spark, sf_dir):
    return rounded(_paths(spark, sf_dir).select("particle", "k", "es", "lon", "lat"), 7)


def cloud_stats(spark, sf_dir):
    return rounded(drift.cloud_stats(_paths(spark, sf_dir)).select("k", "es", "lon", "lat", "spread_km", "n"))


def mean_path(spark, sf_dir):
    return rounded(drift.mean_path(_paths(spark, sf_dir)))


def trajectory_bbox(spark, sf_dir):
    return rounded(drift.cloud_bbox(_paths(spark, sf_dir)))


def cloud_at(spark, sf_dir):
    times = spark.range(60).select((F.lit(T_OBS_S) - F.col("id") * 9001.0).alias("q"))
    return drift.nearest_step(drift.cloud_stats(_paths(spark, sf_dir)), times)


def source_distance(spark, sf_dir):
    """How far the sources of two halves of the particles are apart after three days."""
    p = _paths(spark, sf_dir)
    return rounded(drift.source_distance_km(p.where("particle % 2 = 0"), p.where("particle % 2 = 1"), 72.0))


def position_at(spark, sf_dir):
    return rounded(attribution.positions_on_grid(views.transits(spark, sf_dir), T_OBS_S, DT_S, STEPS))


def position_at_times(spark, sf_dir):
    """The same at times that follow no grid, by one window over reports and times."""
    t = views.transits(spark, sf_dir)
    times = t.select("mmsi").distinct().withColumn("q", F.explode(F.array(*(F.lit(T_OBS_S - 86_400.0 * d - 1234.5 * d * d) for d in range(12)))))
    last = t.groupBy("mmsi").agg(F.max(geo.epoch_s("ts")).alias("q"))
    return rounded(attribution.positions_at(t, times.union(last)), 6)


def _co(spark, sf_dir):
    stats = drift.cloud_stats(_paths(spark, sf_dir))
    return attribution.colocate(attribution.positions_on_grid(views.transits(spark, sf_dir), T_OBS_S, DT_S, STEPS), stats)


def colocation_score(spark, sf_dir):
    return rounded(_co(spark, sf_dir).select("mmsi", "k", "dist_km", "z", "score"))


def _anomaly(df: DataFrame) -> DataFrame:
    return df.select("mmsi").distinct().withColumn("anomaly_confidence", F.col("mmsi") * 37 % 1000 / 1000)


def _funnel(spark, sf_dir):
    t = views.transits(spark, sf_dir)
    return attribution.rank_vessels(t, drift.cloud_stats(_paths(spark, sf_dir)), T_OBS_S, DT_S, STEPS, _anomaly(t))


def rank_vessels(spark, sf_dir):
    df = _funnel(spark, sf_dir)
    df = df.withColumns({c: geo.epoch_s(c) for c in ("est_release_time", "release_window_start", "release_window_end")})
    return rounded(df.drop("vessel_type"))


def funnel_counts(spark, sf_dir):
    return attribution.funnel_counts(_funnel(spark, sf_dir))


def topn_candidates(spark, sf_dir):
    return rounded(attribution.top_candidates(_funnel(spark, sf_dir), TOP_N).select("mmsi", "attribution_score", "min_z"))


def _twin_rows(top: DataFrame) -> DataFrame:
    """Stand-in evidence of forward runs, by arithmetic, for the candidates that would be simulated."""
    return top.select("mmsi", (F.col("mmsi") * 53 % 1000 / 1000).alias("digital_twin_score"))


def _fused(spark, sf_dir):
    f = stored(_funnel(spark, sf_dir), "funnel")
    return fusion.fuse(f, _twin_rows(attribution.top_candidates(f, TOP_N)))


def fuse(spark, sf_dir):
    return rounded(_fused(spark, sf_dir).select("rank", "mmsi", "attribution_score", "anomaly_confidence", "digital_twin_score", "confidence", "evidence_flags"))


def conclusion(spark, sf_dir):
    c = fusion.conclude(_fused(spark, sf_dir))
    return c.select("level", "top_mmsi", "top_name", F.round("top_confidence", 2).alias("top_confidence"), "n_candidates", "n_within_ambiguity_margin", F.concat_ws(",", F.transform("shortlist", lambda m: m.cast("string"))).alias("shortlist"))


def twin_position(spark, sf_dir):
    """Position evidence of clouds that stand for candidates: particles in seven groups at step 12."""
    clouds = _paths(spark, sf_dir).where("k = 12").withColumn("mmsi", F.col("particle") % 7)
    return rounded(twin.position_evidence(clouds, OBS, F.lit(30.0)).select("mmsi", "centroid_km", "ensemble_sigma_km", "model_sigma_km", "position_z", "position_score"))


def footprint_iou(spark, sf_dir):
    """Shape evidence of the same groups (no SQL counterpart; held against plain Python in the tests)."""
    clouds = _paths(spark, sf_dir).where("k = 12").withColumn("mmsi", F.col("particle") % 7)
    grid = {"west": 32.4, "north": 31.8, "pixel_deg": 0.002, "height": 160, "width": 200}
    slick = spark.range(800).selectExpr("CAST(80 + id DIV 40 AS INT) AS row", "CAST(90 + id % 40 AS INT) AS col")
    return rounded(twin.shape_evidence(clouds.select("mmsi", "lon", "lat"), OBS, grid, slick, pixel_km2=0.04))


def drift_ensemble(spark, sf_dir):
    """Perturbed backward run by Heun steps with a random walk, to its mean path."""
    parts = views.particles(spark, sf_dir)
    members = drift.perturbed(parts, 7).join(parts.select("particle", "lon0", "lat0"), "particle")
    start = members.withColumn("run_id", F.lit("demo")).withColumn("es0", F.lit(T_OBS_S)).withColumn("steps", F.lit(STEPS))
    paths = drift.simulate(start, *drift.uniform_fields(), 7, dt_min=DT_S / 60)
    return rounded(drift.mean_path(paths, ("run_id",)))


def current_cube(spark, sf_dir):
    """Long values with repeated keys (the first counts) to a dense cube with axis numbers."""
    f = views.current_field(spark, sf_dir)
    rep = f.withColumn("ord", F.lit(0)).union(f.where("lat > 32").withColumn("u", F.col("u") + 1).withColumn("ord", F.lit(1)))
    from pyspark.sql import Window

    first = rep.withColumn("_r", F.row_number().over(Window.partitionBy("t", "lat", "lon").orderBy("ord"))).where("_r = 1").drop("_r", "ord")
    return rounded(field.cube(first).select("i_t", "i_lat", "i_lon", "t", "lat", "lon", "u", "v"), 9)


def nearest_fill(spark, sf_dir):
    return rounded(field.nearest_fill(field.cube(views.current_field(spark, sf_dir))).select("i_t", "i_lat", "i_lon", "u", "v"), 9)


def field_interp(spark, sf_dir):
    """The field at every report; reports later than its last slice count as at that time."""
    q = views.transits(spark, sf_dir).select(F.col("ord").alias("qid"), geo.epoch_s("ts").alias("es"), "lat", "lon")
    grid = stored(field.nearest_fill(field.cube(views.current_field(spark, sf_dir))), "filled")
    return rounded(field.interpolate(q, grid, clamp_time=True), 8)


def coverage_report(spark, sf_dir):
    return rounded(field.coverage(views.current_field(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    uv_roundtrip, sphere_steps, pixel_grid, oil_velocities, drift_uniform, cloud_stats, mean_path, trajectory_bbox, cloud_at, source_distance, position_at,
    position_at_times, colocation_score, rank_vessels, funnel_counts, topn_candidates, fuse, conclusion, twin_position, footprint_iou, drift_ensemble,
    current_cube, nearest_fill, field_interp, coverage_report)}

_WINDS = "w AS (SELECT event_id, value / 10.0::DOUBLE AS speed, CAST((event_id * 53) % 360 AS DOUBLE) AS deg FROM events)"
_SPREAD = "sqrt(var_pop(lon) * power(cos(radians(avg(lat))) * {k}, 2) + var_pop(lat) * power({k}, 2))"
_KM = "111.195"
_CLOUD = PATHS_SQL + f", cloud AS (SELECT k, min(es) AS es, avg(lon) AS lon, avg(lat) AS lat, {_SPREAD.format(k=_KM)} AS spread_km, count(*) AS n FROM paths GROUP BY k)"
_POS = (
    TRANSITS_SQL
    + """, iv AS (
  SELECT *, lead(es) OVER w AS es1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(sog) OVER w AS sog1, lead(es, 2) OVER w IS NULL AS is_last FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY es)
), asked AS ({asked}), pos AS (
  SELECT iv.mmsi, asked.*, iv.lat * (1 - x) + lat1 * x AS lat, iv.lon * (1 - x) + lon1 * x AS lon, (es1 - es) / 60 AS gap_min,
    0.2 + CASE WHEN (es1 - es) / 60 > 30 THEN 0.25 * ((es1 - es) / 60 / 60) * 1.852 * greatest((coalesce(sog, 8) + coalesce(sog1, 8)) / 2, 3) ELSE 0 END AS sigma_km
  FROM iv JOIN asked ON {whose}q >= es AND (q < es1 OR (is_last AND q <= es1)), LATERAL (SELECT (q - es) / (es1 - es) AS x) WHERE es1 IS NOT NULL
)"""
)
_GRID = f"SELECT k, {T_OBS_S} - k * {DT_S} AS q FROM (SELECT unnest(range(1, {STEPS + 1})) AS k)"
_CO = (
    _CLOUD
    + ", "
    + _POS.format(asked=_GRID, whose="")
    + f""", co AS (
  SELECT *, exp(-0.5 * z * z) AS score FROM (SELECT *, dist_km / sqrt(power(greatest(spread_km, 0), 2) + 1.0 + power(sigma_km, 2)) AS z
    FROM (SELECT p.mmsi, p.k, p.q, p.lat, p.lon, p.gap_min, p.sigma_km, c.spread_km, {hav('p.lat', 'p.lon', 'c.lat', 'c.lon')} AS dist_km FROM pos p JOIN cloud c ON p.k = c.k)))"""
)
_RANK = (
    _CO
    + f""", best AS (
  SELECT * FROM (SELECT mmsi, k, q, lat, lon, score, row_number() OVER (PARTITION BY mmsi ORDER BY score DESC, k) AS r FROM co) WHERE r = 1
), ag AS (
  SELECT co.mmsi, min(z) AS min_z, min(dist_km) AS min_dist_km, min(CASE WHEN z <= 2 THEN co.k END) AS kf, max(CASE WHEN z <= 2 THEN co.k END) AS kl,
    max(CASE WHEN abs(co.q - b.q) <= 7200 THEN gap_min END) AS gap FROM co JOIN best b ON co.mmsi = b.mmsi GROUP BY 1
), ve AS (
  SELECT mmsi, arg_min(vessel_name, es) AS vessel_name, count(*) AS n_fixes, count(*) FILTER (WHERE es BETWEEN {T_OBS_S - STEPS * DT_S} AND {T_OBS_S - DT_S}) AS n_in FROM fixes GROUP BY 1
), fun AS (
  SELECT ve.mmsi, vessel_name, n_fixes, b.k IS NOT NULL AS temporal, coalesce(min_z <= 3, FALSE) AS spatial, b.k IS NOT NULL AND (n_in >= 3 OR coalesce(gap, 0) >= 60) AS ais_quality,
    coalesce(b.score, 0) AS attribution_score, min_z, min_dist_km, b.q AS est_release_time, b.lat AS est_release_lat, b.lon AS est_release_lon,
    CASE WHEN b.k IS NOT NULL THEN {T_OBS_S} - coalesce(kl, b.k) * {DT_S} END AS release_window_start, CASE WHEN b.k IS NOT NULL THEN {T_OBS_S} - coalesce(kf, b.k) * {DT_S} END AS release_window_end,
    CASE WHEN b.k IS NOT NULL THEN coalesce(gap, 0) END AS max_ais_gap_min_near_release, CASE WHEN b.k IS NOT NULL THEN ve.mmsi * 37 % 1000 / 1000.0::DOUBLE END AS anomaly_confidence
  FROM ve LEFT JOIN best b ON ve.mmsi = b.mmsi LEFT JOIN ag ON ve.mmsi = ag.mmsi
), funnel AS (SELECT *, temporal AND spatial AND ais_quality AS passes_all, CASE WHEN temporal THEN max_ais_gap_min_near_release >= 60 END AS dark_gap_flag FROM fun)"""
)
_FUSE = (
    _RANK
    + f""", topn AS (SELECT mmsi FROM funnel WHERE passes_all ORDER BY attribution_score DESC, mmsi LIMIT {TOP_N}
), fz AS (
  SELECT *, 0.2 * anomaly_confidence + 0.45 * least(1, greatest(0, attribution_score)) + 0.35 * digital_twin_score AS confidence
  FROM (SELECT f.*, CASE WHEN t.mmsi IS NULL THEN 0 ELSE f.mmsi * 53 % 1000 / 1000.0::DOUBLE END AS digital_twin_score FROM funnel f LEFT JOIN topn t ON f.mmsi = t.mmsi WHERE passes_all)
), fu AS (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, mmsi) AS rank, concat_ws(';', CASE WHEN dark_gap_flag THEN 'AIS_GAP_' || CAST(trunc(max_ais_gap_min_near_release) AS INT) || 'min_NEAR_RELEASE' END,
    CASE WHEN anomaly_confidence > 0.7 THEN 'BEHAVIOURAL_ANOMALY' END, CASE WHEN digital_twin_score >= 0.5 THEN 'PHYSICS_TWIN_MATCH' END) AS evidence_flags FROM fz
)"""
)
SQL = {
    "uv_roundtrip": f"WITH {_WINDS}, x AS (SELECT *, -speed * sin(radians(deg)) AS u, -speed * cos(radians(deg)) AS v, speed * sin(radians(deg)) AS cu, speed * cos(radians(deg)) AS cv FROM w) SELECT event_id, {_r('u v cu cv')}, round(sqrt(u * u + v * v), 6) AS speed_back, CASE WHEN speed = 0 THEN 180.0 ELSE deg END AS from_deg, round(cu * cos(radians(30)) + cv * sin(radians(30)), 6) AS ru, round(-cu * sin(radians(30)) + cv * cos(radians(30)), 6) AS rv FROM x",
    "sphere_steps": f"WITH f AS (SELECT event_id AS ord, 31.0::DOUBLE + 0.08::DOUBLE * (user_id % 50) + 0.0002::DOUBLE * ((user_id % 7) - 3) * h + 0.0005::DOUBLE * (event_id % 11) AS lat, 32.0::DOUBLE + 0.08::DOUBLE * (user_id % 40) + 0.0003::DOUBLE * ((user_id % 5) - 2) * h + 0.0005::DOUBLE * (event_id % 13) AS lon, CAST((event_id * 37) % 360 AS DOUBLE) AS cog, value / 50.0::DOUBLE AS sog FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS h FROM events)), g AS (SELECT *, lat + degrees(cos(radians(cog)) * (sog + 1) * 1000 / 6371008.8) AS lat2, lon + degrees(sin(radians(cog)) * (sog + 1) * 1000 / (6371008.8 * greatest(cos(radians(lat)), 1e-6))) AS lon2 FROM f) SELECT ord, round(lon2, 5) AS lon2, round(lat2, 5) AS lat2, round({hav('lat', 'lon', 'lat2', 'lon2')}, 5) AS km, round(radians(lon2 - lon) * cos(radians(lat)) * 6371.0088, 5) AS x_km, round(radians(lat2 - lat) * 6371.0088, 5) AS y_km FROM g",
    "pixel_grid": f'WITH {views.PIXELS_SQL} SELECT scene_id, "row", col, round(32.0::DOUBLE + (col + 0.5) * 0.0009::DOUBLE, 8) AS lon, round(31.8::DOUBLE - ("row" + 0.5) * 0.0009::DOUBLE, 8) AS lat, CAST("row" AS BIGINT) AS row2, CAST(col AS BIGINT) AS col2 FROM px',
    "oil_velocities": f"WITH {_WINDS}, x AS (SELECT event_id, -speed * sin(radians(deg)) AS a, -speed * cos(radians(deg)) AS b, speed / 20 * sin(radians(deg + 40)) AS c, speed / 20 * cos(radians(deg + 40)) AS d FROM w) SELECT event_id, round(0.9 * (c * cos(radians(-5)) + d * sin(radians(-5))) + 0.033 * (a * cos(radians(10)) + b * sin(radians(10))), 6) AS u, round(0.9 * (-c * sin(radians(-5)) + d * cos(radians(-5))) + 0.033 * (-a * sin(radians(10)) + b * cos(radians(10))), 6) AS v FROM x",
    "drift_uniform": f"WITH {PATHS_SQL} SELECT particle, k, es, round(lon, 7) AS lon, round(lat, 7) AS lat FROM paths",
    "cloud_stats": f"WITH {_CLOUD} SELECT k, n, {_r('es lon lat spread_km')} FROM cloud",
    "mean_path": f"WITH {PATHS_SQL} SELECT round(es, 6) AS es, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round({_SPREAD.format(k='(6371.0088::DOUBLE * pi() / 180)')}, 6) AS spread_km FROM paths GROUP BY es",
    "trajectory_bbox": f"WITH {PATHS_SQL} SELECT round(quantile_cont(lon, 0.025) - 0.05, 6) AS lon_min, round(quantile_cont(lat, 0.025) - 0.05, 6) AS lat_min, round(quantile_cont(lon, 0.975) + 0.05, 6) AS lon_max, round(quantile_cont(lat, 0.975) + 0.05, 6) AS lat_max FROM paths",
    "cloud_at": f"WITH {_CLOUD} SELECT q, arg_min(k, abs(es - q) * 1000 + k) AS k FROM cloud, (SELECT {T_OBS_S} - i * 9001.0::DOUBLE AS q FROM (SELECT unnest(range(0, 60)) AS i)) GROUP BY q",
    "source_distance": f"WITH {PATHS_SQL}, s AS (SELECT particle % 2 AS h, avg(lon) AS lon, avg(lat) AS lat FROM paths WHERE k = 24 GROUP BY 1) SELECT round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS distance_km FROM s a, s b WHERE a.h = 0 AND b.h = 1",
    "position_at": f"WITH {_POS.format(asked=_GRID, whose="")} SELECT mmsi, k, {_r('lat lon gap_min sigma_km')} FROM pos",
    "position_at_times": f"WITH {_POS.format(asked=f'SELECT {T_OBS_S} - 86400.0 * d - 1234.5 * d * d AS q, NULL::BIGINT AS who FROM (SELECT unnest(range(0, 12)) AS d) UNION ALL SELECT max(es), mmsi FROM fixes GROUP BY mmsi', whose='(who IS NULL OR who = iv.mmsi) AND ')} SELECT mmsi, {_r('q lat lon gap_min sigma_km')} FROM pos",
    "colocation_score": f"WITH {_CO} SELECT mmsi, k, {_r('dist_km z score')} FROM co",
    "rank_vessels": f"WITH {_RANK} SELECT mmsi, vessel_name, n_fixes, temporal, spatial, ais_quality, passes_all, dark_gap_flag, {_r('attribution_score min_z min_dist_km est_release_time est_release_lat est_release_lon release_window_start release_window_end max_ais_gap_min_near_release anomaly_confidence')} FROM funnel",
    "funnel_counts": f"WITH {_RANK} SELECT count(*) AS vessels, count(*) FILTER (WHERE temporal) AS n_temporal, count(*) FILTER (WHERE spatial) AS n_spatial, count(*) FILTER (WHERE ais_quality) AS n_ais_quality, count(*) FILTER (WHERE passes_all) AS n_passes_all FROM funnel",
    "topn_candidates": f"WITH {_RANK} SELECT mmsi, round(attribution_score, 6) AS attribution_score, round(min_z, 6) AS min_z FROM funnel WHERE passes_all ORDER BY funnel.attribution_score DESC, mmsi LIMIT {TOP_N}",
    "fuse": f"WITH {_FUSE} SELECT rank, mmsi, evidence_flags, {_r('attribution_score anomaly_confidence digital_twin_score confidence')} FROM fu",
    "conclusion": f"""WITH {_FUSE}, t AS (SELECT max(confidence) AS top, arg_min(mmsi, rank) AS top_mmsi, arg_min(vessel_name, rank) AS top_name, coalesce(max(CASE WHEN rank = 2 THEN confidence END), 0) AS second, count(*) AS n FROM fu),
      c AS (SELECT count(*) AS n_close, string_agg(CAST(mmsi AS VARCHAR), ',' ORDER BY rank) AS shortlist FROM fu, t WHERE confidence >= top - 0.05)
      SELECT CASE WHEN n = 0 THEN 'NO_CANDIDATE' WHEN top >= 0.7 AND top - second >= 0.15 THEN 'STRONG_LEAD' WHEN top >= 0.5 AND n_close > 1 THEN 'AMBIGUOUS_SHORTLIST' WHEN top >= 0.5 THEN 'MODERATE_LEAD' ELSE 'WEAK_INCONCLUSIVE' END AS level,
        top_mmsi, top_name, round(top, 2) AS top_confidence, n AS n_candidates, n_close AS n_within_ambiguity_margin, shortlist FROM t, c""",
    "twin_position": f"""WITH {PATHS_SQL}, g AS (SELECT particle % 7 AS mmsi, avg(lon) AS clon, avg(lat) AS clat, {_SPREAD.format(k=_KM)} / sqrt(2) AS es FROM paths WHERE k = 12 GROUP BY 1),
      z AS (SELECT *, {hav('clat', 'clon', '31.62', '32.62')} AS km FROM g), y AS (SELECT *, km / greatest(sqrt(es * es + 2.25 + 9.0), 1) AS pz FROM z)
      SELECT mmsi, round(km, 6) AS centroid_km, round(es, 6) AS ensemble_sigma_km, 3.0 AS model_sigma_km, round(pz, 6) AS position_z, round(exp(-0.5 * pz * pz), 6) AS position_score FROM y""",
    "current_cube": f"WITH {FIELD_SQL} SELECT i_t, i_lat, i_lon, {_r('t lat lon u v', 9)} FROM fld",
    "nearest_fill": f"WITH {FIELD_SQL} SELECT i_t, i_lat, i_lon, {_r('u v', 9)} FROM filled",
    "field_interp": f"""WITH {FIELD_SQL}, {TRANSITS_SQL.replace("fixes AS", "fx AS").replace("200000000 + user_id AS mmsi", "event_id AS qid")},
      ax AS (SELECT (SELECT list(t ORDER BY t) FROM ts) AS ats, (SELECT list(lat ORDER BY lat) FROM las) AS ala, (SELECT list(lon ORDER BY lon) FROM los) AS alo),
      q AS (SELECT qid, lat < ala[1] OR lat > ala[-1] OR lon < alo[1] OR lon > alo[-1] AS out_of_domain, least(ats[-1], greatest(ats[1], es)) AS es, least(ala[-1], greatest(ala[1], lat)) AS la, least(alo[-1], greatest(alo[1], lon)) AS lo, ats, ala, alo FROM fx, ax),
      c AS (SELECT *, greatest(0, least(len(ats) - 2, len(list_filter(ats, lambda x: x <= es)) - 1)) AS a, greatest(0, least(len(ala) - 2, len(list_filter(ala, lambda x: x <= la)) - 1)) AS b, greatest(0, least(len(alo) - 2, len(list_filter(alo, lambda x: x <= lo)) - 1)) AS c FROM q),
      w AS (SELECT *, (es - ats[a + 1]) / (ats[a + 2] - ats[a + 1]) AS wa, (la - ala[b + 1]) / (ala[b + 2] - ala[b + 1]) AS wb, (lo - alo[c + 1]) / (alo[c + 2] - alo[c + 1]) AS wc FROM c)
      SELECT qid, out_of_domain, round(sum(x * u), 8) AS u, round(sum(x * v), 8) AS v FROM (
        SELECT w.qid, w.out_of_domain, (CASE WHEN f.i_t = a THEN 1 - wa ELSE wa END) * (CASE WHEN f.i_lat = b THEN 1 - wb ELSE wb END) * (CASE WHEN f.i_lon = c THEN 1 - wc ELSE wc END) AS x, f.u, f.v
        FROM w JOIN filled f ON f.i_t BETWEEN a AND a + 1 AND f.i_lat BETWEEN b AND b + 1 AND f.i_lon BETWEEN c AND c + 1) GROUP BY 1, 2""",
    "coverage_report": f"WITH {FIELD_SQL} SELECT min(t) AS t_min, max(t) AS t_max, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, round(avg(CASE WHEN u IS NULL THEN 1 ELSE 0 END), 6) AS missing_fraction FROM fld",
}

"""Forward runs from each candidate's estimated release, compared with the slick that was seen."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwake.functions.geo import KM_PER_DEG, epoch_s, haversine_km
from slickwake.functions.stats import cloud_spread_km, gaussian_score
from slickwake.operators.drift import simulate


def position_evidence(clouds: DataFrame, obs: dict, drift_km: F.Column | None = None, by: str = "mmsi", *, model_error: float = 0.10, least_sigma_km: float = 1.0) -> DataFrame:
    """Distance of each cloud's centre from the slick, in ensemble, slick and model uncertainty."""
    sigma = F.when(F.count("*") > 2, cloud_spread_km("lon", "lat", KM_PER_DEG) / F.sqrt(F.lit(2.0))).otherwise(0.0)
    df = clouds.groupBy(by).agg(F.avg("lon").alias("c_lon"), F.avg("lat").alias("c_lat"), sigma.alias("ensemble_sigma_km"), *([F.max(drift_km).alias("drift_km")] if drift_km is not None else []))
    if drift_km is None:
        df = df.withColumn("drift_km", F.lit(0.0))
    d = haversine_km("c_lat", "c_lon", F.lit(obs["center_lat"]), F.lit(obs["center_lon"]))
    model = model_error * F.greatest("drift_km", F.lit(0.0))
    slick = max(obs["minor_km"], obs["major_km"]) / 4
    df = df.withColumn("centroid_km", d).withColumn("model_sigma_km", model)
    total = F.greatest(F.sqrt(F.pow("ensemble_sigma_km", 2) + slick**2 + F.pow("model_sigma_km", 2)), F.lit(least_sigma_km))
    df = df.withColumn("position_z", F.col("centroid_km") / total)
    return df.withColumn("position_score", gaussian_score("position_z"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of integer points, counter-clockwise, by a monotone chain."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]
    return np.array(half(pts) + half(pts[::-1]))


def fill_hull(corners: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels inside or on a convex polygon of (column, row) corners."""
    mask = np.zeros(shape, bool)
    if len(corners) < 3:
        return mask
    rows, cols = np.mgrid[0 : shape[0], 0 : shape[1]]
    inside = np.ones(shape, bool)
    for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (x1 - x0) * (rows - y0) - (y1 - y0) * (cols - x0) >= 0
    return inside


def footprint(lon: np.ndarray, lat: np.ndarray, grid: dict, trim_pct: float = 80.0) -> np.ndarray:
    """Convex hull of the central particles on the scene's pixel grid (``west, north, pixel_deg, height, width``)."""
    c, r = (lon - grid["west"]) / grid["pixel_deg"] - 0.5, (grid["north"] - lat) / grid["pixel_deg"] - 0.5
    pts = np.column_stack([c, r])
    d = np.linalg.norm(pts - np.median(pts, axis=0), axis=1)
    pts = pts[d <= np.percentile(d, trim_pct)]
    shape = (grid["height"], grid["width"])
    return fill_hull(hull(np.round(pts).astype(int)), shape) if len(pts) >= 3 else np.zeros(shape, bool)


def shape_evidence(clouds: DataFrame, obs: dict, grid: dict, slick: DataFrame, by: str = "mmsi", pixel_km2: float = 0.01) -> DataFrame:
    """Overlap of each candidate's footprint, moved onto the slick's centre, with the slick's pixels (``row, col``).

    A group is one candidate's particles (some hundreds), or the pixels of its footprint.  Footprints and slick meet by
    rows of pixels, so the slick is neither gathered nor sent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lon, lat = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
        m = footprint(lon + obs["center_lon"] - lon.mean(), lat + obs["center_lat"] - lat.mean(), grid)
        r, c = np.nonzero(m)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(r), "row": r, "col": c})

    kind = clouds.schema[by].dataType.simpleString()
    marks = clouds.groupBy(by).applyInPandas(run, f"{by} {kind}, row int, col int")
    seen = slick.select("row", "col", F.lit(1).alias("seen")).distinct()
    hit = marks.join(seen, ["row", "col"], "left").groupBy(by).agg(F.count("*").alias("n"), F.count("seen").alias("both"))
    n_seen = seen.agg(F.count("*").alias("n_seen"))
    each = clouds.select(by).distinct().join(hit, by, "left").na.fill(0, ["n", "both"]).crossJoin(n_seen)  # one row
    union = F.col("n") + F.col("n_seen") - F.col("both")
    return each.select(by, F.coalesce(F.try_divide("both", union), F.lit(0.0)).alias("iou_aligned"), (F.col("n") * pixel_km2).alias("pred_area_km2"))


def digital_twin(candidates: DataFrame, members: DataFrame, wind, current, obs: dict, grid: dict, slick: DataFrame, t_obs_s: float, seed: int, *,
                 dt_min: float = 15.0, diffusivity: float = 10.0, shares: tuple[float, float] = (0.7, 0.3), init_sigma_m: float = 150.0) -> DataFrame:
    """All candidates' forward runs as one job; the same random numbers for each of them.

    A release that isn't before the observation scores 0 with a note.
    """
    c = candidates.select("mmsi", epoch_s("est_release_time").alias("es0"), F.col("est_release_lon").alias("lon0"), F.col("est_release_lat").alias("lat0"))
    c = c.withColumn("hours_drift", (F.lit(t_obs_s) - F.col("es0")) / 3600)
    late = c.where("hours_drift <= 0 OR lon0 IS NULL").select("mmsi", "hours_drift", F.lit(0.0).alias("digital_twin_score"), F.lit("release not before observation").alias("note"))
    todo = c.where("hours_drift > 0 AND lon0 IS NOT NULL").withColumn("steps", F.ceil(F.col("hours_drift") * 60 / dt_min).cast("int"))
    # top_n candidates times a fixed number of particles
    start = todo.select("mmsi", F.col("mmsi").cast("string").alias("run_id"), "es0", "lon0", "lat0", "steps", "hours_drift").crossJoin(members)
    spread = lambda k: init_sigma_m * F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "particle"), F.lit(1 << 40)) + 0.5) / float(1 << 40)))
    turn = 2 * np.pi * (F.pmod(F.xxhash64(F.lit(seed), F.lit(9), "particle"), F.lit(1 << 40)) / float(1 << 40))
    east = F.degrees(spread(8) * F.cos(turn) / (6_371_008.8 * F.cos(F.radians("lat0"))))
    north = F.degrees(spread(8) * F.sin(turn) / 6_371_008.8)
    start = start.withColumn("lon0", F.col("lon0") + east).withColumn("lat0", F.col("lat0") + north)
    paths = simulate(start.drop("mmsi", "hours_drift"), wind, current, seed, 1, dt_min=dt_min, diffusivity=diffusivity)
    ends = paths.withColumn("mmsi", F.col("run_id").cast("long")).join(todo.select("mmsi", "steps", F.col("lon0").alias("r_lon"), F.col("lat0").alias("r_lat")), "mmsi").where("k = steps")
    mean = ends.groupBy("mmsi").agg(F.avg("lon").alias("m_lon"), F.avg("lat").alias("m_lat"), F.first("r_lon").alias("r_lon"), F.first("r_lat").alias("r_lat"))
    moved = mean.select("mmsi", haversine_km("r_lat", "r_lon", "m_lat", "m_lon").alias("moved_km"))
    pos = position_evidence(ends.join(moved, "mmsi"), obs, F.col("moved_km"))
    shape = shape_evidence(ends.select("mmsi", "lon", "lat"), obs, grid, slick, pixel_km2=obs["pixel_km2"])
    out = pos.join(shape, "mmsi").join(todo.select("mmsi", "hours_drift"), "mmsi")
    out = out.withColumn("obs_area_km2", F.lit(float(obs["area_km2"]))).withColumn("area_ratio", F.col("pred_area_km2") / F.greatest("obs_area_km2", F.lit(1e-9)))
    out = out.withColumn("digital_twin_score", shares[0] * F.col("position_score") + shares[1] * F.col("iou_aligned")).withColumn("note", F.lit(None).cast("string"))
    keep = ["mmsi", "hours_drift", "iou_aligned", "centroid_km", "position_z", "position_score", "ensemble_sigma_km", "model_sigma_km", "pred_area_km2", "obs_area_km2", "area_ratio", "digital_twin_score", "note"]
    return out.select(keep).unionByName(late, allowMissingColumns=True)

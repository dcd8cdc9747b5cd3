"""Which vessel was where the slick came from: positions at cloud times, co-location scores, the funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s, from_epoch_s, haversine_km
from slickwake.functions.stats import gaussian_score, position_sigma_km


def _in_time(tracks: DataFrame) -> list[str]:
    """Order of a vessel's reports: time, and ingest where times are equal (tracks of ``ais.clean`` have one report a time)."""
    return ["es", "ord"] if "ord" in tracks.columns else ["es"]


def positions_on_grid(tracks: DataFrame, t_obs_s: float, dt_s: float, steps: int, sigma_km: float = 0.2) -> DataFrame:
    """Interpolated positions at ``t_obs - k * dt`` for k = 1..steps, where the track covers that time.

    Each interval between two reports makes the grid points that fall into it, so the cost is reports plus matches and
    no report is compared with a time that it doesn't bracket.  Intervals are closed at the start; a track's last one at
    both ends.
    """
    order = Window.partitionBy("mmsi").orderBy(*_in_time(tracks))
    nxt = F.lead(F.struct("es", "lat", "lon", "sog")).over(order)
    is_last = F.lead("es", 2).over(order).isNull()
    iv = tracks.withColumn("es", epoch_s("ts")).withColumn("_n", nxt).withColumn("_last", is_last).where("_n IS NOT NULL")
    open_end = (F.lit(t_obs_s) - F.col("_n.es")) / dt_s
    k0 = F.when(F.col("_last"), F.ceil(open_end)).otherwise(F.floor(open_end) + 1)
    k1 = F.floor((F.lit(t_obs_s) - F.col("es")) / dt_s)
    iv = iv.withColumn("_k0", F.greatest(k0, F.lit(1))).withColumn("_k1", F.least(k1, F.lit(steps))).where("_k0 <= _k1")
    df = iv.withColumn("k", F.explode(F.sequence(F.col("_k0").cast("int"), F.col("_k1").cast("int"))))
    gap = F.col("_n.es") - F.col("es")
    w = F.when(gap > 0, (F.lit(t_obs_s) - F.col("k") * dt_s - F.col("es")) / gap).otherwise(0.0)
    return df.select(
        "mmsi",
        "k",
        (F.col("lat") * (1 - w) + F.col("_n.lat") * w).alias("lat"),
        (F.col("lon") * (1 - w) + F.col("_n.lon") * w).alias("lon"),
        (gap / 60).alias("gap_min"),
        position_sigma_km(gap / 60, "sog", "_n.sog", sigma_km).alias("sigma_km"),
    )


def positions_at(tracks: DataFrame, times: DataFrame, sigma_km: float = 0.2) -> DataFrame:
    """The same at any times: ``times`` has ``mmsi, q`` (epoch seconds).  Reports and times share one window per vessel."""
    fix = F.struct("es", "lat", "lon", "sog")
    each = tracks.withColumn("es", epoch_s("ts"))
    # the report before each report is taken among reports alone; times asked for come in afterwards
    each = each.withColumn("prev", F.lag(fix).over(Window.partitionBy("mmsi").orderBy("es")))
    fixes = each.select("mmsi", "es", fix.alias("fix"), "prev", F.lit(None).cast("double").alias("q"))
    none = F.lit(None).cast(fixes.schema["fix"].dataType)
    asked = times.select("mmsi", F.col("q").alias("es"), none.alias("fix"), none.alias("prev"), "q").distinct()
    order = Window.partitionBy("mmsi").orderBy(F.col("es"), F.col("q").isNotNull())
    last = F.last(F.when(F.col("fix").isNotNull(), F.struct("fix", "prev")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before, first_of = last["fix"], last["prev"]
    after = F.first("fix", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    df = fixes.unionByName(asked).withColumn("_a", before).withColumn("_b", after).withColumn("_z", first_of)
    df = df.where("q IS NOT NULL AND _a IS NOT NULL")
    # a time on the last report belongs to the interval that ends there
    on_last = F.col("_b").isNull() & (F.col("_a.es") == F.col("q"))
    df = df.where(F.col("_b").isNotNull() | on_last)
    a, b = F.when(on_last, F.coalesce("_z", "_a")).otherwise(F.col("_a")), F.when(on_last, F.col("_a")).otherwise(F.col("_b"))
    df = df.withColumn("_s", a).withColumn("_e", b)
    gap = F.col("_e.es") - F.col("_s.es")
    w = F.when(gap > 0, (F.col("q") - F.col("_s.es")) / gap).otherwise(0.0)
    return df.select(
        "mmsi", "q", (F.col("_s.lat") * (1 - w) + F.col("_e.lat") * w).alias("lat"), (F.col("_s.lon") * (1 - w) + F.col("_e.lon") * w).alias("lon"),
        (gap / 60).alias("gap_min"), position_sigma_km(gap / 60, "_s.sog", "_e.sog", sigma_km).alias("sigma_km"),
    )


def colocate(positions: DataFrame, stats: DataFrame, *, least_sigma_km: float = 1.0) -> DataFrame:
    """Distance to the cloud's centre in its own and the position's uncertainty, at each step."""
    cloud = stats.select("k", F.col("es").alias("q"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), "spread_km")
    df = positions.join(cloud, "k")
    d = haversine_km("lat", "lon", "c_lat", "c_lon")
    var = F.pow(F.greatest("spread_km", F.lit(0.0)), 2) + least_sigma_km**2 + F.pow("sigma_km", 2)
    df = df.withColumn("dist_km", d).withColumn("z", d / F.sqrt(var))
    return df.withColumn("score", gaussian_score("z"))


def rank_vessels(tracks: DataFrame, stats: DataFrame, t_obs_s: float, dt_s: float, steps: int, anomaly: DataFrame | None = None, *, gate_z: float = 3.0, plausible_z: float = 2.0, least_sigma_km: float = 1.0,
                 fix_sigma_km: float = 0.2, near_release_s: float = 7200.0, dark_gap_min: float = 60.0, fewest_fixes: int = 3, window_by_step: bool = False) -> DataFrame:
    """The funnel: one row per vessel.  Vessels that the run's time doesn't cover have nulls from ``min_z`` on.

    Backward runs count steps from the observation, so the first plausible step is the latest time; the window's ends are
    in order of time, or by step with ``window_by_step``.
    """
    vessels = tracks.groupBy("mmsi").agg(
        F.min_by("vessel_name", "ts").alias("vessel_name"),
        F.min_by("vessel_type", "ts").alias("vessel_type"),
        F.count("*").alias("n_fixes"),
        F.count_if(epoch_s("ts").between(t_obs_s - steps * dt_s, t_obs_s - dt_s)).alias("n_in_window"),
    )
    co = colocate(positions_on_grid(tracks, t_obs_s, dt_s, steps, fix_sigma_km), stats, least_sigma_km=least_sigma_km)
    plausible = F.col("z") <= plausible_z
    best = F.max_by(F.struct("k", "q", "lat", "lon", "score"), F.struct("score", -F.col("k")))
    per = co.groupBy("mmsi").agg(
        best.alias("b"), F.min("z").alias("min_z"), F.min("dist_km").alias("min_dist_km"),
        F.min(F.when(plausible, F.col("k"))).alias("k_first"), F.max(F.when(plausible, F.col("k"))).alias("k_last"),
    )
    # no step has a score: the first step counts, whether it is covered or not
    first = co.where("k = 1").select("mmsi", F.struct("k", "q", "lat", "lon", "score").alias("f"))
    none = F.struct(F.lit(1).alias("k"), F.lit(t_obs_s - dt_s).alias("q"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(0.0).alias("score"))
    per = per.join(first, "mmsi", "left").withColumn("b", F.when(F.col("b.score") > 0, F.col("b")).otherwise(F.coalesce("f", none))).drop("f")
    gaps = co.join(per.select("mmsi", F.col("b.q").alias("bq")), "mmsi").where(F.abs(F.col("q") - F.col("bq")) <= near_release_s).groupBy("mmsi").agg(F.max("gap_min").alias("gap"))
    df = vessels.join(per, "mmsi", "left").join(gaps, "mmsi", "left")
    covered = F.col("b").isNotNull()
    gap = F.when(covered, F.coalesce("gap", F.lit(0.0)))
    at = lambda k: from_epoch_s(F.lit(t_obs_s) - F.coalesce(k, F.col("b.k")) * dt_s)
    start, end = (F.col("k_first"), F.col("k_last")) if window_by_step else (F.col("k_last"), F.col("k_first"))
    spatial = F.coalesce(F.col("min_z") <= gate_z, F.lit(False))
    quality = covered & ((F.col("n_in_window") >= fewest_fixes) | F.coalesce(gap >= dark_gap_min, F.lit(False)))
    df = df.select(
        "mmsi", "vessel_name", "vessel_type", "n_fixes", covered.alias("temporal"), spatial.alias("spatial"), quality.alias("ais_quality"),
        (covered & spatial & quality).alias("passes_all"), F.coalesce("b.score", F.lit(0.0)).alias("attribution_score"), "min_z", "min_dist_km",
        F.when(covered, from_epoch_s(F.col("b.q"))).alias("est_release_time"), F.col("b.lat").alias("est_release_lat"), F.col("b.lon").alias("est_release_lon"),
        F.when(covered, at(start)).alias("release_window_start"), F.when(covered, at(end)).alias("release_window_end"),
        gap.alias("max_ais_gap_min_near_release"), (gap >= dark_gap_min).alias("dark_gap_flag"),
    )
    if anomaly is None:
        return df.withColumn("anomaly_confidence", F.when(F.col("temporal"), 0.0))
    a = anomaly.select("mmsi", F.col("anomaly_confidence").alias("_a"))
    return df.join(a, "mmsi", "left").withColumn("anomaly_confidence", F.when(F.col("temporal"), F.coalesce("_a", F.lit(0.0)))).drop("_a")


def funnel_order() -> list:
    return [F.col("passes_all").desc(), F.col("attribution_score").desc(), F.col("mmsi")]


def top_candidates(funnel: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` survivors in funnel order."""
    return funnel.where("passes_all").orderBy(*funnel_order()).limit(n)


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.agg(F.count("*").alias("vessels"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("temporal", "spatial", "ais_quality", "passes_all")))

"""Vessel position reports: cleaning, segments, regular resampling, gap filling, features, tracks.

Columns: ``mmsi, ts (TIMESTAMP_NTZ), lat, lon, sog, cog, vessel_name, vessel_type, ord`` where ``ord`` is the order of
ingest.  Every window is partitioned by vessel (and segment), so one shuffle by vessel serves them all, and a long
history is split by time before it comes here (``sources``), never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import FEATURE_M_PER_DEG, KM_PER_NM, epoch_s, from_epoch_s, haversine_km
from slickwake.functions.stats import cancels, clip, sine_cosine

SEGMENT = ["mmsi", "segment_id"]


def _track():
    return Window.partitionBy("mmsi").orderBy("ts")


def _speed_kn() -> F.Column:
    """Implied speed from the previous row; null for the first and for no time in between."""
    hours = F.col("dt_s") / 3600
    return F.when(hours > 0, F.col("step_km") / hours / KM_PER_NM)


def _with_steps(df: DataFrame) -> DataFrame:
    prev = F.lag(F.struct("es", "lat", "lon")).over(_track())
    return (
        df.withColumn("_p", prev)
        .withColumn("dt_s", F.col("es") - F.col("_p.es"))
        .withColumn("step_km", haversine_km(F.col("_p.lat"), F.col("_p.lon"), "lat", "lon"))
        .drop("_p")
    )


def clean(raw: DataFrame, *, teleport_kn: float = 200.0) -> DataFrame:
    """Valid positions, first report of a time, clipped speed, course in [0, 360), no teleports.

    A teleport is judged against the previous deduplicated row, so the row that returns from one goes too.
    """
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    first = F.row_number().over(Window.partitionBy("mmsi", "ts").orderBy("ord"))
    df = raw.where(ok).withColumn("_rn", first).where("_rn = 1").drop("_rn")
    df = df.withColumn("sog", clip("sog", 0, 40)).withColumn("cog", F.pmod("cog", F.lit(360.0))).withColumn("es", epoch_s("ts"))
    df = _with_steps(df).where(F.coalesce(_speed_kn(), F.lit(0.0)) <= teleport_kn)
    return df.drop("dt_s", "step_km")


def segments(cleaned: DataFrame, *, longest_gap_min: float = 60.0, top_speed_kn: float = 50.0) -> DataFrame:
    """Adds ``gap_min, segment_id, internal_gap_min``: a new segment after a long gap or an implausible step."""
    gap = F.coalesce(F.col("dt_s"), F.lit(0.0)) / 60
    df = _with_steps(cleaned).withColumn("gap_min", gap)
    boundary = (F.col("gap_min") > longest_gap_min) | (F.coalesce(_speed_kn(), F.lit(0.0)) > top_speed_kn)
    df = df.withColumn("_b", boundary).withColumn("segment_id", F.sum(F.col("_b").cast("int")).over(_track().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("internal_gap_min", F.when(F.col("_b"), 0.0).otherwise(F.col("gap_min"))).drop("_b", "dt_s", "step_km")


def segment_meta(seg: DataFrame) -> DataFrame:
    return seg.groupBy(*SEGMENT).agg(F.count("*").alias("n_raw"))


def resample(seg: DataFrame, *, every_min: int = 6, fewest_fixes: int = 4) -> DataFrame:
    """Bins of segments with enough fixes: ``bin_no`` counts steps from midnight of the segment's first day (``day0``)."""
    step = every_min * 60
    whole = Window.partitionBy(*SEGMENT)
    df = seg.withColumn("_n", F.count("*").over(whole)).where(F.col("_n") >= fewest_fixes)
    df = df.withColumn("day0", F.floor(F.min("es").over(whole) / 86400) * 86400)
    df = df.withColumn("bin_no", F.floor((F.col("es") - F.col("day0")) / step))
    # in order of time, which sums of courses that cancel out depend on
    one = Window.partitionBy(*SEGMENT, "bin_no").orderBy("es").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sin, cos = sine_cosine("cog", "_cancels")
    df = df.withColumn("_cancels", cancels("cog", one)).withColumns({"_sin": sin, "_cos": cos})
    bins = df.groupBy(*SEGMENT, "day0", "bin_no").agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.avg("sog").alias("sog"),
        F.avg("_sin").alias("_sin"),
        F.avg("_cos").alias("_cos"),
        F.max("internal_gap_min").alias("internal_gap_min"),
        F.count("*").alias("n_fixes"),
        F.min(F.struct("es", "vessel_name", "vessel_type")).alias("head"),
    )
    return bins.withColumn("cog", F.pmod(F.degrees(F.atan2("_sin", "_cos")), F.lit(360.0))).drop("_sin", "_cos")


def _interpolated(name: str, reach: int) -> F.Column:
    """At bin ``at``: linear between known bins, for at most ``reach`` bins after one; after the last, its value for as many."""
    back, ahead = F.col(f"_back_{name}"), F.col(f"_ahead_{name}")
    since = F.col("at") - back["i"]
    line = back["x"] + (ahead["x"] - back["x"]) * since / (ahead["i"] - back["i"])
    own = F.when(F.col("at") == F.col("bin_no"), F.col(name))
    return F.when(own.isNotNull(), own).when(back.isNull() | (since > reach), None).when(ahead.isNull(), back["x"]).otherwise(line)


def fill_gaps(bins: DataFrame, *, every_min: int = 6, reach: int = 3, fewest_bins: int = 15, speedless: bool = False) -> DataFrame:
    """Every bin between a segment's first and last, interpolated over ``reach`` bins; segments of too few bins go.

    Bins without a speed go too, and so all of a segment that has none, unless ``speedless`` keeps them.  Each bin makes
    the missing ones behind it, so all is done in the partitions that segments already have.
    """
    order, whole = Window.partitionBy(*SEGMENT).orderBy("bin_no"), Window.partitionBy(*SEGMENT)
    df = bins.withColumn("first", F.min("head").over(whole)).withColumn("_next", F.lead("bin_no").over(order))
    for c in ("lat", "lon", "sog"):
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("bin_no").alias("i"), F.col(c).alias("x")))
        df = df.withColumn(f"_back_{c}", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn(f"_ahead_{c}", F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    # places are known in every bin, so no bin beyond the reach would stay
    end = F.least(F.coalesce(F.col("_next") - 1, F.col("bin_no")), F.col("bin_no") + reach)
    df = df.withColumn("at", F.explode(F.sequence("bin_no", end)))
    own = lambda c: F.when(F.col("at") == F.col("bin_no"), F.col(c)).alias(c)
    df = df.select(*SEGMENT, "day0", F.col("at").alias("bin_no"), "first", own("cog"), own("internal_gap_min"), *(_interpolated(c, reach).alias(c) for c in ("lat", "lon", "sog")))
    df = df.where("lat IS NOT NULL AND lon IS NOT NULL")
    if not speedless:
        df = df.where("sog IS NOT NULL")
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*SEGMENT))).where(F.col("_n") >= fewest_bins)
    order = Window.partitionBy(*SEGMENT).orderBy("bin_no")
    cog = F.coalesce(
        F.last("cog", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("cog", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    return df.select(
        *SEGMENT,
        (F.col("day0") + F.col("bin_no") * every_min * 60).alias("es"),
        "lat",
        "lon",
        "sog",
        cog.alias("cog"),
        F.coalesce("internal_gap_min", F.lit(0.0)).alias("internal_gap_min"),
        F.col("first.vessel_name").alias("vessel_name"),
        F.col("first.vessel_type").alias("vessel_type"),
    )


def features(filled: DataFrame) -> DataFrame:
    """Metres east and north of the segment's first bin, and cyclic course and hour of day (seconds don't count)."""
    order = Window.partitionBy(*SEGMENT).orderBy("es")
    start = F.first(F.struct("lat", "lon")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    hod = F.floor(F.pmod("es", F.lit(86400.0)) / 60) / 60
    angle = 2 * 3.141592653589793 * hod / 24
    df = filled.withColumn("_s", start)
    return df.select(
        *filled.columns,
        ((F.col("lon") - F.col("_s.lon")) * FEATURE_M_PER_DEG * F.cos(F.radians("_s.lat"))).alias("east_m"),
        ((F.col("lat") - F.col("_s.lat")) * FEATURE_M_PER_DEG).alias("north_m"),
        F.sin(F.radians("cog")).alias("cog_sin"),
        F.cos(F.radians("cog")).alias("cog_cos"),
        F.sin(angle).alias("hod_sin"),
        F.cos(angle).alias("hod_cos"),
    ).withColumn("ts", from_epoch_s("es"))


def regular(seg: DataFrame, *, every_min: int = 6, fewest_fixes: int = 4, reach: int = 3, fewest_bins: int = 15, speedless: bool = False) -> DataFrame:
    """Segments on a regular grid: bins, their gaps filled, and features."""
    bins = resample(seg, every_min=every_min, fewest_fixes=fewest_fixes)
    return features(fill_gaps(bins, every_min=every_min, reach=reach, fewest_bins=fewest_bins, speedless=speedless))


def tracks(cleaned: DataFrame) -> DataFrame:
    """Cleaned reports of vessels with two or more."""
    df = cleaned.withColumn("n_fixes", F.count("*").over(Window.partitionBy("mmsi")))
    return df.where("n_fixes >= 2")

"""Behavioural anomaly: motion sequences, jumps, out-of-fold robust scores, vessel confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwake.functions.stats import angle_between, sigmoid
from slickwake.operators.quantiles import exact_quantiles
from slickwake.operators.traffic import recent
from slickwake.sources.scratch import stored

SEGMENT = ["mmsi", "segment_id"]
FEATURES = ("east_m", "north_m", "sog", "cog_sin", "cog_cos", "hod_sin", "hod_cos")


def sequences(feat: DataFrame, history: int = 12) -> DataFrame:
    """``x``: features of the ``history`` bins before a bin; ``y1, y2``: how far its next step is from the last one.

    The history excludes the bin itself.  Bins without a full history or a next bin have no sequence.
    """
    order = Window.partitionBy(*SEGMENT).orderBy("es")
    past = F.collect_list(F.array(*(F.col(c).cast("float") for c in FEATURES))).over(order.rowsBetween(-history, -1))
    df = feat.select(
        *SEGMENT,
        "es",
        past.alias("x"),
        (F.row_number().over(order) - 1).alias("t"),
        *((F.lead(c).over(order) - 2 * F.col(c) + F.lag(c).over(order)).alias(f"y{i}") for i, c in enumerate(("east_m", "north_m"), 1)),
    )
    return df.where((F.col("t") >= history) & F.col("y1").isNotNull()).withColumn("cv_error_m", F.hypot("y1", "y2"))


def jumps(feat: DataFrame) -> DataFrame:
    """Absolute change of speed and course since the bin before; 0 for a segment's first."""
    order = Window.partitionBy(*SEGMENT).orderBy("es")
    return feat.withColumn("speed_jump", F.coalesce(F.abs(F.col("sog") - F.lag("sog").over(order)), F.lit(0.0))).withColumn(
        "course_jump", F.coalesce(angle_between("cog", F.lag("cog").over(order)), F.lit(0.0))
    )


def vessel_folds(df: DataFrame, n_folds: int, seed: int = 5) -> DataFrame:
    """``mmsi, fold``: vessels dealt in turn, in the order of a seeded arithmetic hash.

    Vessels are ranked inside hash ranges first and ranges are numbered by running sums, so no task sorts all of them.
    """
    key = F.pmod((F.col("mmsi") % 1_000_003) * 7919 + F.lit(seed) * 104_729, F.lit(1_000_003))
    v = df.select("mmsi").distinct().withColumn("_k", key).withColumn("_r", (F.col("_k") / 4096).cast("int"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = v.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # 245 ranges
    total = starts.agg(F.sum("_n").alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_k", "mmsi")) - 1
    ranked = v.withColumn("_rank", rank).join(F.broadcast(starts), "_r").crossJoin(F.broadcast(total))  # one row
    folds = F.greatest(F.lit(2), F.least(F.lit(n_folds), F.col("_all")))
    return ranked.select("mmsi", F.pmod(F.col("_rank") + F.col("_start"), folds).cast("int").alias("fold"))


def robust_z(df: DataFrame, columns: list[str], n_folds: int, seed: int = 5) -> DataFrame:
    """Adds ``z_<column>``: distance from the median of the vessels of all other folds, in scaled median deviations.

    A fold's statistics are over the rows of the other folds; a fold without other rows uses all rows' mean deviation.
    Deviations that vanish fall back to the population deviation, or 1.
    """
    df = stored(df, "scored")
    rows = stored(df.join(vessel_folds(df, n_folds, seed), "mmsi"), "folds")
    # each fold's figures are over the rows of others: conditions inside aggregations, so no row is copied
    pairs = [(f, c) for f in range(n_folds) for c in columns]
    train = {f"{f}:{c}": F.when(F.col("fold") != f, F.col(c).cast("double")) for f, c in pairs}
    spread = rows.agg(*(F.stddev_pop(x).alias(k) for k, x in train.items())).first()
    median = exact_quantiles(rows, train, 0.5)
    deviation = exact_quantiles(rows, {k: F.abs(x - F.lit(median[k])) for k, x in train.items() if median[k] is not None}, 0.5)

    def z(c: str) -> Column:
        out = F.lit(None).cast("double")
        for f in range(n_folds):
            k = f"{f}:{c}"
            if median[k] is not None:
                scale = deviation[k] * 1.4826 if deviation[k] > 1e-9 else spread[k] or 1.0
                out = F.when(F.col("fold") == f, (F.col(c) - median[k]) / scale).otherwise(out)
        return out

    return rows.select(*df.columns, "fold", *(z(c).alias(f"z_{c}") for c in columns))


def point_scores(feat: DataFrame, pred_error: DataFrame | None, n_folds: int = 4, behaviour: float = 0.7, recent_hours: float | None = None) -> DataFrame:
    """Anomaly of each bin: weighted positive parts of the behaviour and the report-quality scores.

    With ``recent_hours`` the share of silence in the hours before a bin, by a frame over time across the vessel's segments,
    counts for quality as the gaps inside segments do.
    """
    df = jumps(feat)
    quality_of = ["internal_gap_min"]
    if recent_hours is not None:
        df = recent(df, recent_hours).drop("recent_n", "recent_sog", "recent_sog_range", "recent_gap_min")
        quality_of.append("recent_silence")
    if pred_error is None:
        df = df.withColumn("pred_error_m", F.lit(0.0))
    else:
        df = df.join(pred_error.select(*SEGMENT, "es", "pred_error_m"), [*SEGMENT, "es"], "left").withColumn("pred_error_m", F.coalesce("pred_error_m", F.lit(0.0)))
    df = robust_z(df, [*quality_of, "speed_jump", "course_jump", "pred_error_m"], n_folds)
    zero = F.lit(0.0)
    quality = F.greatest(*(F.col(f"z_{c}") for c in quality_of), zero)
    moved = F.greatest(0.4 * F.col("z_speed_jump") + 0.3 * F.col("z_course_jump") + 0.3 * F.col("z_pred_error_m"), zero)
    return df.withColumn("ais_quality_z", quality).withColumn("behavior_z", moved).withColumn("final_point_score", behaviour * F.col("behavior_z") + (1 - behaviour) * F.col("ais_quality_z"))


def vessel_scores(points: DataFrame) -> DataFrame:
    """Confidence of each vessel: sigmoid of the larger of the median and the 95th percentile of its bins."""
    p = points.groupBy("mmsi").agg(F.percentile("final_point_score", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count("*").alias("n_points"))
    raw = F.greatest(F.col("p")[0], F.col("p")[1])
    return p.select("mmsi", raw.alias("anomaly_raw"), sigmoid(raw).alias("anomaly_confidence"), "n_points")

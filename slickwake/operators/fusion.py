"""Evidence of three kinds in one ranking, and how strong a lead it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwake.functions.stats import clip
from slickwake.operators.quantiles import ranked

TEXT = "A ranking of leads for further investigation by weight of evidence, not a probability of guilt; to be confirmed by other evidence."
NO_CANDIDATE = "No vessel was at the place and time of the backtracked slick."


def fuse(funnel: DataFrame, twin: DataFrame, weights: tuple[float, float, float] = (0.20, 0.45, 0.35)) -> DataFrame:
    """``weights``: of behaviour, place and time, and forward runs.  Survivors of the funnel with twin evidence (none: 0), ``confidence, rank, evidence_flags``; ties by ``mmsi``."""
    df = funnel.where("passes_all").join(twin, "mmsi", "left").withColumn("digital_twin_score", F.coalesce("digital_twin_score", F.lit(0.0)))
    scores = F.col("anomaly_confidence"), clip("attribution_score", 0, 1), F.col("digital_twin_score")
    confidence = weights[0] * scores[0] + weights[1] * scores[1] + weights[2] * scores[2]
    flags = F.concat_ws(
        ";",
        F.when(F.col("dark_gap_flag"), F.concat(F.lit("AIS_GAP_"), F.col("max_ais_gap_min_near_release").cast("int").cast("string"), F.lit("min_NEAR_RELEASE"))),
        F.when(F.col("anomaly_confidence") > 0.7, F.lit("BEHAVIOURAL_ANOMALY")),
        F.when(F.col("digital_twin_score") >= 0.5, F.lit("PHYSICS_TWIN_MATCH")),
    )
    return ranked(df.withColumn("confidence", confidence).withColumn("evidence_flags", flags), [F.col("confidence").desc(), F.col("mmsi")])


def conclude(fused: DataFrame, *, strong: float = 0.70, clear_margin: float = 0.15, moderate: float = 0.50, ambiguous: float = 0.05) -> DataFrame:
    """One row: level of the lead, its margin, and the shortlist of those within the ambiguity margin."""
    top = fused.agg(F.max("confidence").alias("top"), F.max_by("mmsi", -F.col("rank")).alias("top_mmsi"), F.max_by("vessel_name", -F.col("rank")).alias("top_name"),
                    F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"), F.count("*").alias("n_candidates"))
    close = fused.crossJoin(F.broadcast(top.select("top"))).where(F.col("confidence") >= F.col("top") - ambiguous)  # one row
    near = close.agg(F.count("*").alias("n_close"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "mmsi"))), lambda s: s["mmsi"]).alias("shortlist"))
    df = top.crossJoin(near)
    margin = F.col("top") - F.coalesce("second", F.lit(0.0))
    level = (
        F.when(F.col("n_candidates") == 0, "NO_CANDIDATE")
        .when((F.col("top") >= strong) & (margin >= clear_margin), "STRONG_LEAD")
        .when((F.col("top") >= moderate) & (F.col("n_close") > 1), "AMBIGUOUS_SHORTLIST")
        .when(F.col("top") >= moderate, "MODERATE_LEAD")
        .otherwise("WEAK_INCONCLUSIVE")
    )
    return df.select(
        level.alias("level"), "top_mmsi", "top_name", F.bround("top", 3).alias("top_confidence"), F.bround(margin, 3).alias("margin_to_second"), "n_candidates",
        F.col("n_close").alias("n_within_ambiguity_margin"), "shortlist", F.when(F.col("n_candidates") == 0, NO_CANDIDATE).otherwise(TEXT).alias("text"),
    )

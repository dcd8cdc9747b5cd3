"""Cases from scene to lead: from tables or from files, one or many, and their results in one folder.

Stages hand over DataFrames; what a later plan needs as numbers (the slick's centre, the run's length) is one row.
Settings are keyword arguments of the operators that use them, given by operator: ``settings={"segments": {...}}``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.functions.geo import from_epoch_s
from slickwake.operators import ais, anomaly, attribution, drift, fusion, models, observe, raster, twin
from slickwake.operators import field as fields
from slickwake.sources import currents, reports, sinks
from slickwake.sources.scratch import stored

#: Operators that take settings of a case.
OPERATORS = ("detect", "evidence", "clean", "segments", "regular", "models", "rank", "fuse", "conclude")


@dataclass
class CaseResult:
    case_id: str
    status: str
    observation: dict | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    provenance: dict = field(default_factory=dict)


def summary(parts: list[DataFrame]) -> DataFrame:
    """Rows of cases with what each has; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_case(spark: SparkSession, case_id: str, scene: DataFrame, grid: dict, t_obs_s: float, reports_df: DataFrame, forcing, *, hours: float = 72.0, dt_min: float = 15.0,
             n_particles: int = 600, n_twin: int = 300, diffusivity: float = 10.0, top_n: int = 8, seed: int = 20190405, fit_models: bool = True,
             provenance: dict | None = None, settings: dict[str, dict] | None = None) -> CaseResult:
    """``scene``: ``scene_id, row, col, value`` in decibels; ``forcing``: (wind, current) fields; ``reports_df``: canonical reports."""
    own = {name: {} for name in OPERATORS} | (settings or {})
    if unknown := set(own) - set(OPERATORS):
        raise ValueError(f"no operator of a case is called {sorted(unknown)}")
    steps = drift.n_steps(hours, dt_min)
    run = {"hours": hours, "dt_min": dt_min, "n_particles": n_particles, "n_twin": n_twin, "diffusivity": diffusivity, "top_n": top_n, "seed": seed, "fit_models": fit_models}
    result = CaseResult(case_id, "OK", provenance=dict(provenance or {}) | {"t_obs_s": t_obs_s, "grid": grid, "run": run, "settings": {k: v for k, v in own.items() if v}})
    found = stored(raster.detect_dark(scene, **own["detect"]).withColumn("db", F.col("value")), "detected")
    obs, components, pixels = observe.observe(found, grid, **own["evidence"])
    if obs is None:
        result.status = "NO_OIL_DETECTED"
        return result
    result.observation = obs
    start = observe.sample_particles(pixels, n_particles, grid, seed)
    members = drift.ensemble(spark, n_particles, seed)
    runs = members.join(start, "particle").withColumn("run_id", F.lit(case_id)).withColumn("es0", F.lit(float(t_obs_s))).withColumn("steps", F.lit(steps))
    paths = stored(drift.simulate(runs, *forcing, seed, dt_min=dt_min, diffusivity=diffusivity), "paths")
    for name, f in zip(("wind", "current"), forcing, strict=True):
        if isinstance(f, fields.GridField) and (outside := fields.points_outside(paths, f)):
            result.warnings.append(f"{outside} points of paths lie outside the field of {name}, which goes on as at its edge")
    stats = stored(drift.cloud_stats(paths), "cloud")

    cleaned = stored(ais.clean(reports_df, **own["clean"]), "cleaned")
    feat = stored(ais.regular(ais.segments(cleaned, **own["segments"]), **own["regular"]), "features")
    seqs = anomaly.sequences(feat)
    if fit_models:
        errors, means = models.out_of_fold(seqs, **own["models"])
        result.tables["model_errors"] = means
    else:
        errors = seqs.select("mmsi", "segment_id", "es", F.col("cv_error_m").alias("pred_error_m"))
    scores = stored(anomaly.vessel_scores(anomaly.point_scores(feat, errors)), "vessels")
    funnel = stored(attribution.rank_vessels(ais.tracks(cleaned), stats, t_obs_s, dt_min * 60, steps, scores, **own["rank"]), "funnel")
    top = attribution.top_candidates(funnel, top_n)
    twins = stored(twin.digital_twin(top, members.where(F.col("particle") < n_twin), *forcing, obs, grid, pixels, t_obs_s, seed, dt_min=dt_min, diffusivity=diffusivity), "twin")
    fused = stored(fusion.fuse(funnel, twins, **own["fuse"]), "fused")
    result.tables |= {
        "components": components, "outline": observe.outline(pixels, grid), "mean_path": drift.mean_path(paths), "funnel": funnel, "twin": twins, "suspects": fused,
        "conclusion": fusion.conclude(fused, **own["conclude"]), "vessels": scores, "paths": paths,
    }
    return result


def run_files(spark: SparkSession, case_id: str, scene: DataFrame, grid: dict, acquired_s: float | None, reports_path: str, currents_path: str | None = None, wind: DataFrame | None = None, *,
              hours: float = 72.0, pad_deg: float = 1.0, history_hours: float = 24.0, column_map: dict[str, str] | None = None, verified_surface: bool = False,
              export_to: str | None = None, **options) -> CaseResult:
    """A case from files: reports as CSV, currents as CSV or a table, winds as a table ``t, lat, lon, u, v``.

    A scene without a time is refused, since nothing can be traced back from it.  Fields must cover the scene (with
    ``pad_deg`` around it) from the start of the run to the observation, or ``ForcingCoverageError`` says what is missing.
    Only reports of that box and time (and ``history_hours`` before it) are read.  With ``export_to``, the fields are also
    written there as the case's tables.
    """
    if acquired_s is None:
        raise ValueError(f"{case_id}: the scene has no acquisition time; give one")
    west, north, side = grid["west"], grid["north"], grid["pixel_deg"]
    bbox = (west - pad_deg, north - grid["height"] * side - pad_deg, west + grid["width"] * side + pad_deg, north + pad_deg)
    begin = acquired_s - hours * 3600
    current = currents.read_current(spark, currents_path, bbox=bbox, verified_surface=verified_surface) if currents_path else None
    covered = {name: fields.assert_coverage(f, bbox, begin, acquired_s, name) for name, f in (("wind", wind), ("current", current)) if f is not None}
    forcing = currents.build_forcing(spark, "tables" if covered else "uniform", wind, current)
    if export_to:
        currents.export_forcing(spark, forcing, bbox, begin, acquired_s, export_to, case_id)
    when = spark.range(1).select(*(from_epoch_s(F.lit(t)).cast("string") for t in (begin - history_hours * 3600, acquired_s))).first()
    seen = reports.read_reports(spark, reports_path, column_map, bbox, tuple(when))
    told = {"scene": "table", "reports": reports_path, "currents": currents_path, "wind": "table" if wind is not None else "uniform", "coverage": covered}
    return run_case(spark, case_id, scene, grid, acquired_s, seen, forcing, hours=hours, provenance=told, **options)


def run_cases(cases: dict[str, Callable[[], CaseResult]], folder: str, run_id: str) -> dict[str, str]:
    """Run and save cases one after another; each is a set of jobs of its own.  A case that fails is noted and the next
    one runs.  Returns the status of each."""
    status = {}
    for case_id, run in cases.items():
        try:
            result = run()
            save_case(result, folder, run_id)
            status[case_id] = result.status
        except (ValueError, KeyError, RuntimeError) as e:
            status[case_id] = f"FAILED: {e}"
    return status


def benchmark_detectors(px: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(per scene, summary) of detectors on labelled scenes (``scene_id, row, col, value, gt``): overlap with the truth, and
    objects without a pixel of it."""
    rows = []
    for name, detect in detectors.items():
        found = stored(detect(px.drop("gt")).select(*raster.PIXEL, F.col("mask").alias("pred")).join(px.select(*raster.PIXEL, "gt"), raster.PIXEL), "detected")
        alarms = raster.false_alarm_objects(raster.components(found.withColumnRenamed("pred", "mask").select(*raster.PIXEL, "mask")), found.select(*raster.PIXEL, "gt"))
        one = raster.seg_metrics(found).join(alarms, "scene_id", "left").na.fill(0, ["false_alarm_objects"])
        rows.append(one.withColumn("detector", F.lit(name)))
    per_scene = stored(summary(rows), "benchmark")
    numbers = ("dice", "iou", "precision", "recall", "false_alarm_objects")
    return per_scene, per_scene.groupBy("detector").agg(*(F.avg(c).alias(c) for c in numbers), F.count("*").alias("n_scenes"))


def save_benchmark(per_scene: DataFrame, means: DataFrame, folder: str) -> None:
    for name, df in (("detector_benchmark_per_scene", per_scene), ("detector_benchmark_summary", means)):
        df.write.mode("overwrite").option("header", "true").csv(f"{folder.rstrip('/')}/{name}")


def save_case(result: CaseResult, folder: str, run_id: str) -> None:
    """Tables, one report document, what the run was made of, and a row of the summary."""
    spark = SparkSession.active()
    row = {"case_id": result.case_id, "status": result.status}
    if result.status == "OK":
        for name in ("funnel", "suspects", "mean_path", "outline"):
            sinks.write_table(result.tables[name], folder, name, result.case_id)
        sinks.write_report({n: result.tables[n] for n in ("conclusion", "suspects")}, folder, result.case_id)
        c = result.tables["conclusion"].first()
        row |= {"area_km2": float(result.observation["area_km2"]), "level": c["level"], "top_mmsi": c["top_mmsi"], "top_confidence": c["top_confidence"], "n_candidates": c["n_candidates"]}
    told = {"case_id": result.case_id, "run_id": run_id, "warnings": result.warnings, **result.provenance}
    sinks.write_metadata(spark, folder, f"metadata/case_id={result.case_id}", json.dumps(told, default=str))
    kinds = "case_id string, status string, area_km2 double, level string, top_mmsi long, top_confidence double, n_candidates long"
    names = [k.split()[0] for k in kinds.split(", ")]
    sinks.write_summary(spark.createDataFrame([tuple(row.get(n) for n in names)], kinds), folder, run_id)

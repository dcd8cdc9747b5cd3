import json
import math

import pytest
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s, from_epoch_s
from slickwake.operators import drift
from slickwake.operators.field import ForcingCoverageError
from slickwake.plans import case
from slickwake.sources.scenes import demo_scene

T_OBS = 1554436320.0
BACK_H = 10.0


def straight_track(mmsi, lon, lat, es, bearing, knots=11.0, hours=4.0, silent=(0.0, 0.0)):
    """Reports every ten minutes of a vessel that passes a place at a time, but for the minutes in ``silent``."""
    rows = []
    for minute in range(int(-hours * 60), int(hours * 60) + 1, 10):
        if silent[0] < minute < silent[1]:
            continue
        km = knots * 1.852 * minute / 60
        y, x = km * math.cos(math.radians(bearing)) / 111.195, km * math.sin(math.radians(bearing)) / 111.195 / math.cos(math.radians(lat))
        rows.append((mmsi, es + minute * 60, lat + y, lon + x, knots, bearing, f"V{mmsi}"))
    return rows


def test_vessel_at_the_release_comes_first(spark, tmp_path):
    """Four vessels around a place that the slick drifted away from; only two were there when it did."""
    lat0, lon0, size, side = 31.2, 32.4, 128, 0.0009
    grid = {"west": lon0 - size * side / 2, "north": lat0 + size * side / 2, "pixel_deg": side, "height": size, "width": size}
    scene = demo_scene(spark, "s", lat0, lon0, 2.0, size)
    start = spark.createDataFrame([(0, lon0, lat0, 0.025)], "particle long, lon0 double, lat0 double, windage double")
    at = drift.uniform_paths(start, T_OBS, BACK_H, dt_min=30).orderBy(F.desc("k")).first()
    km = 1 / 111.195
    passes = [
        straight_track(41, at["lon"], at["lat"], at["es"], 120.0),
        straight_track(42, at["lon"], at["lat"], at["es"] - 14 * 3600, 120.0),
        straight_track(43, at["lon"], at["lat"] - 35 * km, at["es"], 80.0),
        straight_track(44, at["lon"] + 4 * km, at["lat"], at["es"], 20.0, silent=(-70, 70)),
    ]
    rows = spark.createDataFrame([r for p in passes for r in p], "mmsi long, es double, lat double, lon double, sog double, cog double, vessel_name string")
    seen = rows.select("mmsi", from_epoch_s("es").alias("ts"), "lat", "lon", "sog", "cog", "vessel_name", F.lit("cargo").alias("vessel_type"), F.col("es").cast("long").alias("ord"))
    r = case.run_case(spark, "c1", scene, grid, T_OBS, seen, drift.uniform_fields(), hours=24.0, dt_min=30.0, n_particles=120, fit_models=False, settings={"detect": {"window": 64}})
    assert r.status == "OK"
    found = {x["mmsi"]: x for x in r.tables["funnel"].withColumn("es", epoch_s("est_release_time")).collect()}
    top = r.tables["suspects"].where("rank = 1").first()
    assert top["mmsi"] == 41 and abs(found[41]["es"] - at["es"]) <= 3600 and found[41]["min_dist_km"] < 3
    assert found[44]["dark_gap_flag"] and found[44]["passes_all"] and not found[43]["passes_all"]
    assert found[41]["attribution_score"] > found[42]["attribution_score"]
    c = r.tables["conclusion"].first()
    assert c["level"] in ("AMBIGUOUS_SHORTLIST", "MODERATE_LEAD", "STRONG_LEAD") and "guilt" in c["text"]
    for _ in range(2):  # a case that is saved again counts once
        case.save_case(r, str(tmp_path), "r1")
    assert spark.read.parquet(str(tmp_path / "summary")).count() == 1
    assert spark.read.json(str(tmp_path / "report" / "case_id=c1")).first()["case_id"] == "c1"
    told = json.loads(spark.read.text(str(tmp_path / "metadata" / "case_id=c1")).first()[0])
    assert told["run"]["n_particles"] == 120 and told["settings"] == {"detect": {"window": 64}}
    ring = r.tables["outline"].where("ring = 0").orderBy("n").select("lon", "lat").collect()
    km2 = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 * 111.195**2 * math.cos(math.radians(lat0))
    assert abs(km2 / r.observation["area_km2"] - 1) < 0.1


def files(spark, folder, hours=range(-30, 2, 6)):
    """A slick, two vessels and currents in files, as a case has them."""
    grid = {"west": 32.3 - 48 * 0.0009, "north": 31.3 + 48 * 0.0009, "pixel_deg": 0.0009, "height": 96, "width": 96}
    scene = demo_scene(spark, "s", 31.3, 32.3, 1.0, 96, lookalike=False).drop("gt")
    stamp = "%Y-%m-%d %H:%M:%S"
    import datetime as dt

    at = lambda h: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=T_OBS + 3600 * h)
    rows = ["MMSI,# Timestamp,Latitude,Longitude,SOG,COG"]
    rows += [f"{m},{at(-h / 10).strftime(stamp)},{31.3 + la * h / 240:.5f},{32.3 - 0.002 * h:.5f},9,90" for m, la in ((111, 0.0), (222, 1.0)) for h in range(0, 240)]
    (folder / "reports.csv").write_text("\n".join(rows))
    lines = ["date,time_utc,latitude,longitude,water_u_mps,water_v_mps"]
    lines += [f"{at(h):%Y-%m-%d},{at(h):%H:%M:%S},{29 + 0.5 * i},{30 + 0.5 * j},0.1,0.0" for h in hours for i in range(10) for j in range(10)]
    (folder / "Day_1.csv").write_text("\n".join(lines))
    return scene, grid, str(folder / "reports.csv"), str(folder)


def test_case_from_files(spark, tmp_path):
    scene, grid, reports, currents = files(spark, tmp_path)
    small = {"hours": 12.0, "dt_min": 60.0, "n_particles": 40, "n_twin": 20, "fit_models": False, "settings": {"detect": {"window": 64}}}
    out = tmp_path / "out"
    run = lambda t, folder=currents: case.run_files(spark, "c", scene, grid, t, reports, folder, **small)
    status = case.run_cases({"good": lambda: run(T_OBS), "late": lambda: run(T_OBS + 48 * 3600), "timeless": lambda: run(None)}, str(out), "r")
    assert status["good"] == "OK" and "does not cover" in status["late"] and "no acquisition time" in status["timeless"]
    suspects = spark.read.parquet(str(out / "suspects")).collect()
    assert [r["mmsi"] for r in suspects] == [111]
    told = json.loads(spark.read.text(str(out / "metadata" / "case_id=c")).first()[0])
    assert told["coverage"]["current"]["missing_fraction"] == 0.0
    with pytest.raises(ForcingCoverageError):
        run(T_OBS + 48 * 3600)


def test_detector_benchmark_files(spark, tmp_path):
    px = demo_scene(spark, "a", 31.3, 32.3, 1.0, 48, lookalike=False).union(demo_scene(spark, "b", 31.3, 32.3, 0.5, 48, seed=2, lookalike=False))
    truth = px.select("scene_id", "row", "col", F.col("gt").alias("mask"))
    perfect = lambda p: p.join(truth, ["scene_id", "row", "col"])
    corner = lambda p: p.withColumn("mask", F.expr("row < 3 AND col < 3"))
    per_scene, means = case.benchmark_detectors(px, {"perfect": perfect, "corner": corner})
    case.save_benchmark(per_scene, means, str(tmp_path))
    back = {r["detector"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "detector_benchmark_summary")).collect()}
    assert back["perfect"]["dice"] > 0.999 and back["perfect"]["false_alarm_objects"] == 0 and back["corner"]["dice"] == 0 and back["corner"]["false_alarm_objects"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "detector_benchmark_per_scene")).count() == 4

import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwake.functions import geo
from slickwake.operators import drift, field
from slickwake.sources import currents

STILL = {"wind": (0.0, 0.0), "current": (0.2, 90.0)}


def start(spark, n=5, lon=32.0, lat=31.5, windage=0.0):
    return spark.range(n).select(F.col("id").alias("particle"), F.lit(lon).alias("lon0"), F.lit(lat).alias("lat0"), F.lit(windage).alias("windage"))


def test_directions(spark):
    u, v = geo.met_wind_to_uv(F.lit(5.0), F.lit(270.0))
    cu, cv = geo.current_to_uv(F.lit(1.0), F.lit(90.0))
    s, d = geo.uv_to_speed_dir_from(u, v)
    ru, rv = geo.rotate_uv(F.lit(0.0), F.lit(1.0), F.lit(90.0))
    r = spark.range(1).select(u, v, cu, cv, s, d, ru, rv).first()
    assert np.allclose(list(r), [5, 0, 1, 0, 5, 270, 1, 0], atol=1e-9)


def test_forward_distance(spark):
    p = drift.uniform_paths(start(spark), 0.0, 24.0, 1, **STILL)
    end = p.where("k = 96").select(geo.haversine_km(F.lit(31.5), F.lit(32.0), "lat", "lon").alias("km")).first()
    assert abs(end["km"] - 17.28) < 0.05


def test_native_and_simulated_paths_agree(spark):
    p = start(spark, 7, windage=0.03).withColumn("lon0", F.col("lon0") + F.col("particle") * 0.01)
    native = drift.uniform_paths(p, 1e6, 30.0, dt_min=60.0)
    m = p.select("*", F.lit("r").alias("run_id"), F.lit(1e6).alias("es0"), F.lit(30).alias("steps"), F.lit(1.0).alias("wind_scale"), F.lit(0.0).alias("wind_rot"), F.lit(1.0).alias("cur_scale"), F.lit(0.0).alias("cur_rot"))
    sim = drift.simulate(m, *drift.uniform_fields(), 1, dt_min=60.0, diffusivity=0.0)
    d = native.alias("a").join(sim.alias("b"), ["particle", "k"]).select(F.max(F.abs(F.col("a.lon") - F.col("b.lon"))), F.max(F.abs(F.col("a.lat") - F.col("b.lat"))), F.count("*")).first()
    assert d[0] < 1e-9 and d[1] < 1e-9 and d[2] == 7 * 31


def test_backward_undoes_forward(spark):
    fwd = drift.uniform_paths(start(spark, 1, windage=0.03), 0.0, 12.0, 1, current=(0.2, 90.0)).where("k = 48").first()
    back = drift.uniform_paths(start(spark, 1, fwd["lon"], fwd["lat"], 0.03), 0.0, 12.0, -1, current=(0.2, 90.0)).where("k = 48")
    assert back.select(geo.haversine_km("lat", "lon", F.lit(31.5), F.lit(32.0)).alias("km")).first()["km"] < 0.01


def test_partitioning_does_not_matter(spark):
    m = drift.ensemble(spark, 20, 3).select("*", F.lit("r").alias("run_id"), F.lit(0.0).alias("es0"), F.lit(5).alias("steps"), F.lit(32.0).alias("lon0"), F.lit(31.0).alias("lat0"))
    a, b = (sorted(map(tuple, drift.simulate(m.repartition(n), *drift.uniform_fields(), 3, dt_min=60.0).collect())) for n in (1, 5))
    assert a == b


def cube(spark):
    f = [(float(t), 31.0 + i, 32.0 + j, 0.1 * i + t / 1e5, 0.2 * j) for t in (0, 21600) for i in range(3) for j in range(3)]
    return spark.createDataFrame(f, "t double, lat double, lon double, u double, v double")


def test_gridded_field_matches_interpolation(spark):
    f = cube(spark)
    rng = np.random.default_rng(0)
    q = [(i, float(rng.uniform(0, 21600)), float(rng.uniform(30.5, 33.5)), float(rng.uniform(31.5, 34.5))) for i in range(50)]
    rows = {r["qid"]: (r["u"], r["v"]) for r in field.interpolate(spark.createDataFrame(q, "qid long, es double, lat double, lon double"), field.nearest_fill(field.cube(f))).collect()}
    g = field.GridField.of(f)
    u, v = g.uv(np.array([x[2] for x in q]), np.array([x[3] for x in q]), np.array([x[1] for x in q]))
    assert np.allclose([rows[i] for i in range(50)], np.column_stack([u, v]), atol=1e-12)


def test_no_extrapolation_in_time(spark):
    f = cube(spark)
    with pytest.raises(field.ForcingCoverageError):
        field.GridField.of(f).uv(np.array([31.0]), np.array([32.0]), np.array([30000.0]))
    with pytest.raises(field.ForcingCoverageError):
        field.assert_coverage(f, (20.0, 31.0, 33.0, 32.0), 0.0, 100.0)
    assert field.assert_coverage(f, (32.0, 31.0, 34.0, 33.0), 0.0, 21600.0)["missing_fraction"] == 0


def test_current_csv(spark, tmp_path):
    rows = ["date,time_utc,latitude,longitude,water_u_mps,water_v_mps"] + [f"2019-04-05,{h:02d}:00:00,{la},{lo},0.1,0" for h in (0, 6) for la in (31, 32) for lo in (32, 393)]
    (tmp_path / "Day_1.csv").write_text("\n".join(rows + ["2019-04-05,00:00:00,31,32,9,9", "bad,x,31,32,1,1"]) + "\n")
    df = currents.read_current_csv(spark, str(tmp_path))
    assert df.count() == 8 and df.agg(F.max("u")).first()[0] == 0.1 and df.agg(F.max("lon")).first()[0] == 33
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Day_1.csv").write_text("date,time_utc,latitude,longitude,water_u_bottom,water_v_bottom\n")
    with pytest.raises(field.ForcingCoverageError):
        currents.read_current_csv(spark, str(tmp_path / "b"))

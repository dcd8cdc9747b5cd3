"""Interval joins, sketches, frames over time and table functions, against plain Python."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from slickwake.functions import tables
from slickwake.operators import anomaly, intervals, raster, traffic
from slickwake.plans import traffic_queries
from slickwake.sources.scratch import stored

T0 = dt.datetime(2024, 1, 1)


def some_intervals(rng, n):
    rows = []
    for i in range(n):
        a = rng.choice([rng.uniform(-500, 500), float(rng.randint(-50, 50) * 10)])
        length = rng.choice([0.0, rng.uniform(0, 5), 10.0, rng.uniform(0, 100), rng.uniform(0, 900)])
        rows.append((i, rng.choice(["x", "y"]), a, a + length))
    return [*rows, (n, "x", None, 5.0), (n + 1, "x", 5.0, 1.0), (n + 2, None, 0.0, 1.0), (n + 3, "y", -400.0, 40_000.0)]


@pytest.mark.parametrize("on, width", [(["k"], 10.0), ([], 3.0), (["k"], 5000.0)])
def test_overlap_join(spark, on, width):
    rng = random.Random(width)
    left, right = some_intervals(rng, 120), some_intervals(rng, 90)
    a, b = spark.createDataFrame(left, "i long, k string, start double, end double"), spark.createDataFrame(right, "j long, k string, start2 double, end2 double")
    if not on:
        a, b = a.drop("k"), b.drop("k")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, on, width).collect())
    fits = lambda p: p[2] is not None and p[2] <= p[3]
    assert got == sorted((p[0], q[0]) for p in left for q in right if fits(p) and fits(q) and p[2] <= q[3] and q[2] <= p[3] and (not on or p[1] is not None and p[1] == q[1]))


def test_overlap_join_of_nothing(spark):
    a = spark.createDataFrame([(1, 0.0, 1.0)], "i long, start double, end double")
    b = spark.createDataFrame([], "j long, start2 double, end2 double")
    assert intervals.overlap_join(a, b, [], 1.0).count() == 0 and intervals.overlap_join(a.where("false"), b, [], 1.0).columns == ["i", "start", "end", "j", "start2", "end2"]


def test_long_intervals_stay_few_rows(spark):
    """A year among minutes: rows of the join's sides are counted by the pairs that it makes before its filters."""
    a = spark.range(2000).selectExpr("id AS i", "id * 60D AS start", "id * 60D + 50 AS end").union(spark.createDataFrame([(-1, 0.0, 3.15e7)], "i long, start double, end double"))
    b = spark.range(2000).selectExpr("id AS j", "id * 60D + 30 AS start2", "id * 60D + 59 AS end2")
    assert intervals.overlap_join(a, b, [], 60.0).count() == 2000 + 2000


def reports(spark, rng, n=4000):
    rows = [(rng.randint(1, 900), T0 + dt.timedelta(minutes=rng.randint(0, 20 * 1440)), 30 + rng.random() * 2, 31 + rng.random() * 2) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "mmsi long, ts timestamp_ntz, lat double, lon double")


def test_sketches_are_near_exact_counts(spark, tmp_path):
    rng = random.Random(6)
    rows, df = reports(spark, rng)
    kept = stored(traffic.vessel_sketches(df.where("ts < TIMESTAMP_NTZ'2024-01-11'")), "sketches").union(stored(traffic.vessel_sketches(df.where("ts >= TIMESTAMP_NTZ'2024-01-11'")), "sketches"))
    day0 = (T0 - dt.datetime(1970, 1, 1)).days
    bound = 4 * 1.04 / 2 ** (traffic.LG_REGISTERS / 2)
    for box, days in (((31.0, 30.0, 32.99, 31.99), (0, 19)), ((31.5, 30.25, 31.9, 31.2), (3, 8)), ((32.0, 31.0, 32.1, 31.1), (5, 5)), ((10.0, 10.0, 11.0, 11.0), (0, 19))):
        cells = lambda x: int(x // 0.25)
        exact = len({m for m, t, la, lo in rows if days[0] <= (t - T0).days <= days[1] and cells(box[1]) <= cells(la) <= cells(box[3]) and cells(box[0]) <= cells(lo) <= cells(box[2])})
        row = traffic.vessels_within(kept, box, (day0 + days[0], day0 + days[1])).first()
        assert abs((row["n_vessels"] or 0) - exact) <= max(1, bound * exact)


def test_recent_behaviour(spark):
    rng = random.Random(3)
    rows = [(m, float(t), rng.uniform(0, 20) if rng.random() < 0.9 else None) for m in (1, 2) for t in sorted(rng.sample(range(0, 400_000, 50), 60))]
    got = {(r["mmsi"], r["es"]): r for r in traffic.recent(spark.createDataFrame(rows, "mmsi long, es double, sog double"), 12.0, 60.0).collect()}
    for m, t, _ in rows:
        own = [x for x in rows if x[0] == m]
        inside = [x for x in own if t - 43_200 <= x[1] <= t]
        speeds = [x[2] for x in inside if x[2] is not None]
        gaps = [(own[k - 1][1], own[k][1]) for k in range(1, len(own)) if t - 43_200 <= own[k][1] <= t]
        r = got[m, t]
        assert r["recent_n"] == len(inside) and r["recent_sog"] == (pytest.approx(sum(speeds) / len(speeds)) if speeds else None)
        assert r["recent_gap_min"] == (max(b - a for a, b in gaps) / 60 if gaps else None)
        assert r["recent_silence"] == pytest.approx(sum(b - max(a, t - 43_200) for a, b in gaps if b - a > 3600) / 43_200, abs=1e-9)


def test_traffic_cube(spark):
    rows = [("a", 30.1, 31.1, T0, 1.0), ("a", 30.6, 31.1, T0, 3.0), ("b", 30.1, 31.1, T0 + dt.timedelta(hours=5), None), (None, 30.1, 31.1, T0, 5.0)]
    got = {(r["level"], r["vessel_type"], r["cell_row"], r["cell_col"], r["hour"]): (r["n_reports"], r["sog"]) for r in traffic.traffic_cube(spark.createDataFrame(rows, "vessel_type string, lat double, lon double, ts timestamp_ntz, sog double")).collect()}
    assert got[15, None, None, None, None] == (4, 3.0) and got[14, None, None, None, 0] == (3, 3.0) and got[9, None, 60, 62, None] == (3, 3.0)
    assert got[1, None, 60, 62, None] == (1, 5.0) and got[6, "b", None, None, 5] == (1, None)


def test_table_functions(spark):
    tables.register_tables(spark)
    rng = random.Random(2)
    scenes = spark.createDataFrame([(f"s{i}", rng.randint(1, 700), rng.randint(1, 700)) for i in range(20)] + [("none", None, 5)], "scene_id string, height int, width int")
    got = spark.sql("SELECT * FROM tile_corners(TABLE({s}) PARTITION BY scene_id, tile => 64, overlap => 16)", s=scenes)
    assert got.schema["scene_id"].dataType.simpleString() == "string"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, raster.tile_grid(scenes.where("height IS NOT NULL"), 64, 16).collect()))
    for call in ("TABLE({s}), tile => 64, overlap => 64", "TABLE({s}), tile => NULL, overlap => 1"):
        with pytest.raises((AnalysisException, PySparkException), match="overlap"):
            spark.sql(f"SELECT * FROM tile_corners({call})", s=scenes).collect()
    with pytest.raises((AnalysisException, PySparkException), match="height"):
        spark.sql("SELECT * FROM tile_corners(TABLE({s}), tile => 64, overlap => 1)", s=scenes.drop("height")).collect()
    boxes = spark.createDataFrame([(1, 31.0, 30.0, 31.5, 30.25)], "scene_id int, west double, south double, east double, north double")
    points = spark.sql("SELECT * FROM grid_points(TABLE({b}), step => 0.25D)", b=boxes).collect()
    assert sorted((r["i"], r["j"], r["lat"], r["lon"]) for r in points) == [(i, j, 30 + i / 4, 31 + j / 4) for i in range(2) for j in range(3)]


def test_groups_of_sketches(spark):
    _, df = reports(spark, random.Random(1), 500)
    by = traffic.united(traffic.vessel_sketches(df), F.lit(1).alias("one")).first()
    assert abs(by["n_vessels"] - df.select("mmsi").distinct().count()) <= 8


def test_silence_counts_for_quality(spark):
    """Of vessels that move alike, the one with silences between its segments gets the higher scores of quality."""
    rng = random.Random(12)
    rows = []
    for m in range(12):
        hours = [h for h in range(100) if m != 5 or h % 20 < 8]
        rows += [(m, h // 20, h * 3600.0, 10 + rng.random(), 90 + rng.random(), 0.0) for h in hours]
    feat = spark.createDataFrame(rows, "mmsi long, segment_id long, es double, sog double, cog double, internal_gap_min double")
    mean = lambda df: {r["mmsi"]: r["q"] for r in df.groupBy("mmsi").agg(F.avg("ais_quality_z").alias("q")).collect()}
    with_silence, without = mean(anomaly.point_scores(feat, None, recent_hours=24.0)), mean(anomaly.point_scores(feat, None))
    assert max(with_silence, key=with_silence.get) == 5 and with_silence[5] > 2 * max(v for m, v in with_silence.items() if m != 5)
    assert set(without.values()) == {0.0}


def test_encounters_are_those_of_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), who, float(s), float(s + rnd.randrange(30))) for who in range(20) for s in (rnd.randrange(200) for _ in range(4))]
    rows += [(None, 1, 0.0, 9.0), ("a", 2, 9.0, 0.0)]
    want = {}
    for k, w, s, e in rows:
        for k2, w2, s2, e2 in rows:
            if k is not None and k == k2 and w < w2 and s <= e and s2 <= e2 and s <= e2 and s2 <= e:
                n, t = want.get((k, w, w2), (0, 0.0))
                want[k, w, w2] = n + 1, t + min(e, e2) - max(s, s2)
    df = spark.createDataFrame(rows, "kind string, mmsi long, start double, end double")
    for each in (3, 100):
        got = intervals.encounters(df, "kind", "mmsi", each).collect()
        assert len(got) == len(want) and {(r["kind"], r["mmsi"], r["mmsi2"]): (r["n_pairs"], r["shared"]) for r in got} == want


def test_pairs_of_segment_encounters_are_not_moved(spark):
    """Only rows are shuffled: from the join of segments on, there is no exchange."""
    plan = traffic_queries.segment_encounters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Join")[0]


def test_overlap_join_in_parts(spark):
    """A bin dealt into parts gives the same pairs, each once."""
    rng = random.Random(8)
    left, right = ([p for p in some_intervals(rng, n)] for n in (120, 60))
    a, b = spark.createDataFrame(left, "i long, k string, start double, end double").drop("k"), spark.createDataFrame(right, "j long, k string, start2 double, end2 double").drop("k")
    pairs = lambda **kw: sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, [], 10.0, **kw).collect())
    assert pairs(parts=7) == pairs() and len(pairs()) > 1000


def test_copies_of_a_small_side_are_not_broadcast(spark):
    """The copies for parts aren't in the estimates of size, so a broadcast would bring all of them through the driver."""
    a = stored(spark.range(5000).selectExpr("id AS i", "id * 60D AS start", "id * 60D + 50 AS end"), "left")
    b = stored(spark.range(50).selectExpr("id AS j", "id * 6000D AS start2", "id * 6000D + 500 AS end2"), "right")
    met = intervals.overlap_join(a, b, [], 60.0, parts=300)
    assert met.count() == 50 * 9 and "_part" not in met.columns
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_encounters_shuffle_few_copies_of_each_interval(spark):
    """Of 20000 vessels, each with one interval, blocks are shuffled a few times, not each interval once for every 800 vessels."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    written = lambda: {f: os.path.getsize(f) for top in local for d, _, names in os.walk(top) for n in names if n.endswith(".data") for f in [os.path.join(d, n)]}
    df = stored(spark.range(20_000).selectExpr("'a' AS kind", "id AS mmsi", "1.7e9 + 1000D * (id * 7919 % 20000) + rand(3) AS start").withColumn("end", F.expr("start + 1500 + rand(4)")), "segments")
    before = written()
    assert intervals.encounters(df, "kind", "mmsi").count() == 19_999
    after = written()
    assert sum(n for f, n in after.items() if f not in before) < 6 * 20_000 * 24

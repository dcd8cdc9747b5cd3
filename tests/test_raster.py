import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwake.operators import observe, quantiles, raster, twin
from slickwake.sources.scenes import case_specs, demo_scene, pixel_table


def masks(spark, a):
    return pixel_table(spark, [("s", a.astype(float))]).select("scene_id", "row", "col", (F.col("value") > 0).alias("mask"))


def brute_labels(a, eight):
    lab, seen = {}, set()
    for r, c in zip(*np.nonzero(a), strict=True):
        if (r, c) in seen:
            continue
        stack, part = [(r, c)], []
        seen.add((r, c))
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p = y + dy, x + dx
                    if (eight or not dy or not dx) and 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and a[p] and p not in seen:
                        seen.add(p)
                        stack.append(p)
        for p in part:
            lab[p] = min(y * (1 << 20) + x for y, x in part)
    return lab


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity):
    a = np.random.default_rng(3).random((40, 70)) < 0.5
    got = {(r["row"], r["col"]): r["label"] for r in raster.components(masks(spark, a), connectivity=connectivity).collect()}
    assert got == brute_labels(a, connectivity == 8)


def test_closing_erodes_at_the_edge(spark):
    a = np.ones((6, 6), bool)
    out = {(r["row"], r["col"]): r["mask"] for r in raster.open_close(masks(spark, a)).collect()}
    assert not out[0, 0] and out[1, 1] and out[3, 3]


def test_smoothing(spark):
    a = np.random.default_rng(1).normal(size=(20, 17))
    w = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    w /= w.sum()
    p = np.pad(a, 6, "symmetric")
    p = sum(w[i] * p[i : i + 20] for i in range(13))
    want = sum(w[i] * p[:, i : i + 17] for i in range(13))
    got = np.zeros_like(a)
    for r in raster.gaussian_smooth(pixel_table(spark, [("s", a)])).collect():
        got[r["row"], r["col"]] = r["smooth"]
    assert np.allclose(got, want)


@pytest.mark.parametrize("shape", [(30, 40), (64, 64), (130, 101)])
def test_tiles(spark, shape):
    a = np.random.default_rng(2).random(shape)
    a[3:5, 3:5] = np.nan
    rows = raster.predict_tiles(pixel_table(spark, [("s", a)]), lambda t: (t > 0.5).astype(float), 64, 16).collect()
    assert len(rows) == a.size
    got = {(r["row"], r["col"]): r["p"] for r in rows}
    assert all(got[i] == float(np.nan_to_num(a[i]) > 0.5) for i in np.ndindex(*shape))


def test_dark_objects(spark):
    px = demo_scene(spark, "x", 31.3, 32.3, 1.5, 128, 60.0, 5)
    tiled = raster.seg_metrics(raster.detect_dark(px, window=64), "mask").first()
    whole = raster.seg_metrics(raster.detect_dark(px, "global", window=64), "mask").first()
    assert tiled["dice"] > 0.85 and whole["dice"] < 0.5


def test_observation_and_draws(spark):
    px = demo_scene(spark, "x", 31.3, 32.3, 1.5, 96, 90.0, 5, lookalike=False).withColumn("mask", F.col("gt")).withColumn("db", F.col("value"))
    grid = {"west": 32.3 - 48 * 0.0009, "north": 31.3 + 48 * 0.0009, "pixel_deg": 0.0009, "height": 96, "width": 96}
    obs, found, pixels = observe.observe(px, grid)
    assert abs(obs["center_lon"] - 32.3) < 2e-3 and abs(obs["center_lat"] - 31.3) < 2e-3 and abs(obs["area_km2"] - 1.5) < 0.1
    assert abs(obs["orientation_deg"] - 90) < 25 and obs["major_km"] > obs["minor_km"]
    drawn = observe.sample_particles(pixels, 500, grid, 1)
    assert drawn.count() == 500 and abs(drawn.agg(F.avg("lon0")).first()[0] - obs["center_lon"]) < 2e-3
    none, _, _ = observe.observe(px.withColumn("mask", F.lit(False)), grid)
    assert none is None


def test_fallback_to_the_other_detector(spark):
    px = demo_scene(spark, "x", 31.3, 32.3, 1.5, 64, 90.0, 5, lookalike=False).withColumn("db", F.col("value"))
    grid = {"west": 32.3 - 32 * 0.0009, "north": 31.3 + 32 * 0.0009, "pixel_deg": 0.0009, "height": 64, "width": 64}
    obs, info = observe.detect_in_order(px, {"net": lambda p: p.withColumn("mask", F.lit(False)), "otsu": lambda p: p.withColumn("mask", F.col("gt"))}, "net", grid)
    assert obs and info["used"] == "otsu" and info["fell_back"] and info["inter_detector_iou"] == 0


def test_hull_covers_its_edges():
    m = twin.fill_hull(twin.hull(np.array([[2, 2], [6, 2], [6, 6], [2, 6], [4, 4]])), (9, 9))
    assert m.sum() == 25 and m[2, 2] and m[6, 6] and not m[1, 2]


def test_cases(spark):
    assert case_specs(spark).count() == 4


@pytest.mark.parametrize("kind", ["median", "lee", "frost"])
def test_speckle_filters_are_those_of_whole_arrays(spark, kind):
    a = np.random.default_rng(4).gamma(4, 20, (70, 45))
    p = np.pad(a, 2, "symmetric")
    win = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
    mean, var = win.mean(axis=(2, 3)), win.var(axis=(2, 3))
    if kind == "median":
        want = np.median(win, axis=(2, 3))
    elif kind == "lee":
        m2 = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
        want = m2.mean(axis=(2, 3)) + var / (var + a.var() + 1e-8) * (a - mean)
    else:
        w = np.exp(-0.5 * (np.arange(-2, 3) / 2.5) ** 2)
        w /= w.sum()
        rough = 2.0 * var / (mean**2 + 1e-8)
        blend = np.clip(rough / (rough.max() + 1e-8), 0, 1)
        want = blend * a + (1 - blend) * (win * np.outer(w, w)).sum(axis=(2, 3))
    got = np.zeros_like(a)
    for r in raster.despeckle(pixel_table(spark, [("s", a)]), kind).collect():
        got[r["row"], r["col"]] = r["despeckled"]
    assert np.allclose(got, want, rtol=1e-9)


def test_blocks_do_not_matter(spark):
    a = np.random.default_rng(6).random((50, 41))
    px = pixel_table(spark, [("s", a)])
    mean = lambda img, there: np.pad(np.lib.stride_tricks.sliding_window_view(img, (3, 3)).mean(axis=(2, 3)), 1)
    x, y = ({(r["row"], r["col"]): r["m"] for r in raster.by_blocks(px, mean, 1, "value", "m", block=b).collect()} for b in (256, 7))
    assert len(x) == a.size and all(abs(x[k] - y[k]) < 1e-12 for k in x)


def test_predictors_are_validated(spark):
    good = {r["scene"]: r["ok"] for r in raster.validate_predictor(spark, lambda t: np.clip(t / 200, 0, 1), 16, 4).collect()}
    bad = {r["scene"]: r["ok"] for r in raster.validate_predictor(spark, lambda t: t * 0 + 2.0, 16, 4).collect()}
    assert len(good) == 8 and all(good.values()) and not any(bad.values())
    out = raster.normalised(pixel_table(spark, [("s", np.array([[64.0, 96.0], [np.nan, 32.0]]))])).orderBy("row", "col").collect()
    assert [r["value"] for r in out] == [0.0, 1.0, -2.0, -1.0]


def test_outline_of_a_ring(spark):
    m = np.zeros((9, 9), bool)
    m[1:8, 2:7] = True
    m[3:5, 4] = False
    px = pixel_table(spark, [("s", m.astype(float))]).where("value > 0").withColumn("label", F.lit(5).cast("long"))
    rows = observe.outline(px, {"west": 0.0, "north": 0.0, "pixel_deg": 1.0}).orderBy("ring", "n").collect()
    assert {(r["lon"], r["lat"]) for r in rows if r["ring"] == 0} == {(2.0, -1.0), (7.0, -1.0), (7.0, -8.0), (2.0, -8.0)}
    assert {(r["lon"], r["lat"]) for r in rows if r["ring"] == 1} == {(4.0, -3.0), (5.0, -3.0), (5.0, -5.0), (4.0, -5.0)} and max(r["ring"] for r in rows) == 1


def test_footprints_against_plain_python(spark):
    """The overlap of moved hulls with a slick, one candidate at a time."""
    rng = np.random.default_rng(8)
    grid = {"west": 32.0, "north": 31.5, "pixel_deg": 0.01, "height": 60, "width": 60}
    obs = {"center_lon": 32.3, "center_lat": 31.2}
    clouds = {m: (32.4 + 0.05 * rng.standard_normal(80), 31.1 + 0.03 * rng.standard_normal(80)) for m in (1, 2)} | {3: (np.array([32.0]), np.array([31.0]))}
    slick = {(r, c) for r in range(25, 36) for c in range(22, 38)}
    df = spark.createDataFrame([(m, float(x), float(y)) for m, (lo, la) in clouds.items() for x, y in zip(lo, la, strict=True)], "mmsi long, lon double, lat double")
    got = {r["mmsi"]: r for r in twin.shape_evidence(df, obs, grid, spark.createDataFrame(sorted(slick), "row int, col int"), pixel_km2=2.0).collect()}
    for m, (lo, la) in clouds.items():
        x, y = lo + obs["center_lon"] - lo.mean(), la + obs["center_lat"] - la.mean()
        p = np.column_stack([(x - 32.0) / 0.01 - 0.5, (31.5 - y) / 0.01 - 0.5])
        d = np.linalg.norm(p - np.median(p, axis=0), axis=1)
        p = np.round(p[d <= np.percentile(d, 80)]).astype(int)
        # inside the hull: on the same side of every pair of points that has all others on one side
        own = set()
        if len(np.unique(p, axis=0)) >= 3:
            cross = lambda a, b, q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
            edges = [(a, b) for a in p for b in p if tuple(a) != tuple(b) and all(cross(a, b, q) >= 0 for q in p)]
            own = {(r, c) for r in range(60) for c in range(60) if all(cross(a, b, (c, r)) >= 0 for a, b in edges)}
        assert got[m]["pred_area_km2"] == 2.0 * len(own) and got[m]["iou_aligned"] == pytest.approx(len(own & slick) / len(own | slick))


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(9)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 1500), ("d", 999)) for x in (rng.standard_normal(n) if g != "d" else rng.integers(0, 4, n))] + [("a", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    fractions = (0.0, 0.01, 0.5, 0.995, 1.0)
    got = {r["g"]: r["p"] for r in quantiles.exact_percentiles(df, ["g"], F.col("x"), fractions, accuracy).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g, p in got.items():
        assert p == pytest.approx(list(np.quantile([x for k, x in rows if k == g and x is not None], fractions)), abs=1e-12)
    every = [x for _, x in rows if x is not None and x == x]
    assert quantiles.exact_percentiles(df, [], F.col("x"), (0.5,), accuracy).first()["p"][0] == pytest.approx(float(np.median(every)))
    places = [(r["x"], r["k"]) for r in quantiles.ranked(df.where("g = 'c'"), [F.col("x").desc()], "k").collect()]
    assert [k for _, k in sorted(places, reverse=True)] == list(range(1, 1501))

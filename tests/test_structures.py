"""Algorithms that work in rounds or sweeps, against plain Python: outlines, components, nearest cells, non-local means."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwake.operators import field, graph, observe, raster

PIXELS = "scene_id int, label long, row int, col int"


def plain_rings(pixels):
    """Rings of corners of one component: sides clockwise around pixels, the left turn where two ways go on."""
    sides = set()
    for r, c in pixels:
        for a, b in (((r, c), (r, c + 1)), ((r, c + 1), (r + 1, c + 1)), ((r + 1, c + 1), (r + 1, c)), ((r + 1, c), (r, c))):
            sides.discard((b, a)) if (b, a) in sides else sides.add((a, b))
    starts = {}
    for a, b in sides:
        starts.setdefault(a, []).append(b)
    left, rings = set(sides), []
    way = lambda a, b: (b[0] - a[0], b[1] - a[1])
    for side in sorted(sides, key=lambda s: (s[0], way(*s))):
        if side not in left:
            continue
        ring = []
        while side in left:
            left.remove(side)
            ring.append(side)
            a, b = side
            dr, dc = way(a, b)
            end = max(starts[b], key=lambda e: way(b, e) == (-dc, dr))
            side = (b, end)
        area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in ring))
        rings.append((-area, ring[0], [s[0] for k, s in enumerate(ring) if way(*ring[k - 1]) != way(*s)]))
    return [corners for _, _, corners in sorted(rings, key=lambda x: (x[0], x[1][0], way(*x[1])))]


def comb(teeth, height):
    return [(0, c) for c in range(2 * teeth)] + [(r, 2 * t) for r in range(1, height) for t in range(teeth)]


rng = random.Random(4)
SHAPES = {
    "one": [(3, 5)],
    "ring": [(r, c) for r in range(7) for c in range(9) if not (2 <= r <= 4 and 3 <= c <= 5)],
    "holes": [(r, c) for r in range(9) for c in range(9) if (r, c) not in {(1, 1), (2, 2), (5, 5), (6, 5), (5, 6)}],
    "touching": [(0, 0), (1, 1), (2, 0), (1, 3), (0, 2)],
    "ragged": [(r, c) for r in range(30) for c in range(30) if rng.random() < 0.7],
    "comb": comb(40, 60),
}


def test_outlines(spark):
    rows = [(k, 7, r, c) for k, shape in enumerate(SHAPES.values()) for r, c in shape]
    found = {}
    for r in observe.rings(spark.createDataFrame(rows, PIXELS).repartition(5)).collect():
        found.setdefault(r["scene_id"], {}).setdefault(r["ring"], {})[r["n"]] = (r["row"], r["col"])
    for k, shape in enumerate(SHAPES.values()):
        got = [[found[k][ring][n] for n in range(len(found[k][ring]))] for ring in range(len(found[k]))]
        assert got == plain_rings(shape), list(SHAPES)[k]


def test_no_outline_of_nothing(spark):
    assert observe.rings(spark.createDataFrame([], PIXELS)).count() == 0


def test_components_of_long_chains(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n, n), (n + 2, n + 1), (n + 1, n + 2)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n)} | {n + 1: n + 1, n + 2: n + 1}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_spiral_is_one_component(spark):
    size, r, c, d = 25, 0, 0, (0, 1)
    on = set()
    for step in [size, *(x for k in range(size - 1, 0, -2) for x in (k, k))]:
        for _ in range(step):
            on.add((r, c))
            r, c = r + d[0], c + d[1]
        r, c = r - d[0], c - d[1]
        d = (d[1], -d[0])
    px = spark.createDataFrame([(s, y, x, (y, x) in on or s == 1 and (y, x) == (24, 0)) for s in (1, 2) for y in range(size) for x in range(size)], "scene_id int, row int, col int, mask boolean")
    labels = raster.components(px, connectivity=4).groupBy("scene_id", "label").count().collect()
    plain = set()
    for s in (1, 2):
        left = {p for p in itertools.product(range(size), range(size)) if p in on or s == 1 and p == (24, 0)}
        while left:
            todo, part = [min(left)], []
            left.discard(todo[0])
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            plain.add((s, min(part)[0] * (1 << 20) + min(part)[1], len(part)))
    assert {tuple(r) for r in labels} == plain


@pytest.mark.parametrize("share, batch", [(0.05, 10_000), (0.3, 7), (0.0, 3)])
def test_nearest_cells(spark, share, batch):
    rng = random.Random(share * 100)
    nt, na, no = 3, 17, 13
    cells = {(t, a, o): (rng.random(), rng.random()) if t != 1 and rng.random() < share else None for t in range(nt) for a in range(na) for o in range(no)}
    rows = [(float(t), 30.0 + a, 31.0 + o, t, a, o, *(v or (None, None))) for (t, a, o), v in cells.items()]
    grid = spark.createDataFrame(rows, "t double, lat double, lon double, i_t int, i_lat int, i_lon int, u double, v double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        got = {(r["i_t"], r["i_lat"], r["i_lon"]): (r["u"], r["v"]) for r in field.nearest_fill(grid).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for (t, a, o), v in cells.items():
        near = min((((a - y) ** 2 + (o - x) ** 2, y, x) for y in range(na) for x in range(no) if cells[t, y, x]), default=None)
        assert got[t, a, o] == (v or (cells[t, near[1], near[2]] if near else (0.0, 0.0)))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_along_a_column(seed):
    rng = random.Random(seed)
    for n in (1, 2, 9, 60):
        near = [rng.choice([None, *range(12)]) for _ in range(n)]
        want = [min((((q - r) ** 2 + d * d, r) for r, d in enumerate(near) if d is not None), default=(0, None))[1] for q in range(n)]
        assert field.nearest_along(near) == want


def plain_means(img, h, template, search):
    t, s = template // 2, search // 2
    p = np.pad(img, t + s, "symmetric")
    out = np.zeros_like(img)
    for r, c in np.ndindex(*img.shape):
        y, x = r + t + s, c + t + s
        own = p[y - t : y + t + 1, x - t : x + t + 1]
        total = weights = 0.0
        for dy, dx in itertools.product(range(-s, s + 1), repeat=2):
            patch = p[y + dy - t : y + dy + t + 1, x + dx - t : x + dx + t + 1]
            w = math.exp(-((own - patch) ** 2).mean() / h**2)
            total, weights = total + w * p[y + dy, x + dx], weights + w
        out[r, c] = total / weights
    return out


@pytest.mark.parametrize("block", [11, 256])
def test_non_local_means(spark, block):
    g = np.random.default_rng(2)
    img = g.normal(0, 1, (23, 26)) + np.where(np.arange(26) > 12, 6, 0)
    lo, hi = img.min(), img.max()
    want = np.rint(plain_means(np.floor((img - lo) * 255 / (hi - lo)), 10.0, 3, 7))
    px = spark.createDataFrame([("s", r, c, float(img[r, c])) for r, c in np.ndindex(*img.shape)] + [("flat", 0, c, 2.0) for c in range(9)], "scene_id string, row int, col int, value double")
    got = raster.non_local_means(px, 10.0, 3, 7, block=block).collect()
    assert all(r["despeckled"] == (want[r["row"], r["col"]] if r["scene_id"] == "s" else 0.0) for r in got) and len(got) == img.size + 9
    assert set(raster.despeckle(px.where("scene_id = 'flat'"), "nlm").columns) == {*px.columns, "despeckled"}


def test_choice_of_a_detector(spark):
    pairs = [(0.9, 0.8), (0.8, 0.9), (0.85, 0.84), (0.84, 0.85), (None, 0.8), (0.8, None), (0.80, 0.83), (0.5, 0.5), (0.7, 0.679), (None, None)]
    rows = spark.createDataFrame([(k, name, dice) for k, p in enumerate(pairs) for name, dice in zip(("deeplab", "otsu"), p, strict=True)], "case_no int, detector string, dice double")
    got = {r["case_no"]: (r["detector"], r["reason"]) for r in raster.select_detector(rows, by=("case_no",)).collect()}
    better, close = "better", "within_margin"
    assert [got[k] for k in range(10)] == [("deeplab", better), ("otsu", better), ("deeplab", close), ("deeplab", close), ("deeplab", "not_benchmarked"), ("deeplab", "otsu_not_benchmarked"), ("otsu", better), ("deeplab", close), ("deeplab", better), ("deeplab", "not_benchmarked")]
    one = rows.where("case_no = 1")
    assert raster.select_detector(one).first()[:] == ("otsu", better) and raster.select_detector(one, "deeplab", False).first()[:] == ("otsu", "forced_but_unavailable")
    assert raster.select_detector(one, network_available=False).first()[:] == ("otsu", "network_unavailable")


@pytest.mark.parametrize("accuracy, most", [(10_000, 10_000), (20, 3), (100, 40)])
def test_exact_quantiles(spark, accuracy, most):
    from slickwake.operators.quantiles import exact_quantiles

    rng = random.Random(accuracy)
    rows = [(rng.choice([0.0, 0.0, 0.0, 1.0, rng.gauss(0, 5)]), rng.gauss(0, 1), rng.choice([None, float("nan"), 2.0, rng.random()]), None, float(k)) for k in range(1501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    values = {c: F.col(c) for c in "abcde"} | {"odd": F.when(F.col("e") % 2 == 1, F.col("b")), "one": F.when(F.col("e") == 7, F.col("b"))}
    for fraction in (0.5, 0.95, 0.0, 1.0):
        want = df.where("c IS NULL OR NOT isnan(c)").select(F.percentile("c", fraction)).first()[0], *df.select(*(F.percentile(values[k], fraction) for k in ("a", "b", "e", "odd", "one"))).first()
        got = exact_quantiles(df, values, fraction, accuracy, most)
        assert [got[k] for k in ("c", "a", "b", "e", "odd", "one")] == [pytest.approx(w, abs=1e-12) for w in want] and got["d"] is None
    assert exact_quantiles(df.where("false"), values, 0.5) == dict.fromkeys(values)

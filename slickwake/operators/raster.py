"""Scenes as pixel tables: ``scene_id, row, col, value`` and masks (BOOLEAN columns).

Statistics, thresholds, morphology and components are aggregations and neighbour joins, keyed by scene and position, so
scenes of any number and size spread over tasks.  Tiles go to Arrow functions only for kernels over whole windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import EARTH_RADIUS_M, local_km
from slickwake.functions.stats import decibel
from slickwake.operators import graph
from slickwake.operators.quantiles import exact_percentiles
from slickwake.sources.scratch import stored

PIXEL = ["scene_id", "row", "col"]


def clean_pixels(px: DataFrame) -> DataFrame:
    """Missing and -inf to 0, +inf to the scene's largest finite value (1 if there is none)."""
    v = F.col("value")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    top = px.groupBy("scene_id").agg(F.coalesce(F.max(finite), F.lit(1.0)).alias("_top"))
    clean = F.when(v.isNull() | F.isnan(v) | (v == float("-inf")), 0.0).when(v == float("inf"), F.col("_top")).otherwise(v)
    return px.join(top, "scene_id").withColumn("value", clean).select(px.columns)


def stretch(px: DataFrame, units: str = "linear", low: float = 0.01, high: float = 0.995) -> DataFrame:
    """``scaled``: 0..255 between two percentiles of the scene's decibels; missing pixels get the low end."""
    db = px.withColumn("db", decibel("value", F.lit(units)))
    ends = exact_percentiles(db, ["scene_id"], F.col("db"), (low, high))
    df = db.join(ends, "scene_id", "left")
    lo, hi = F.col("p")[0], F.col("p")[1]
    x = (F.coalesce(F.when(~F.isnan("db"), F.col("db")), lo) - lo) / F.greatest(hi - lo, F.lit(1e-6)) * 255
    return df.withColumn("scaled", F.coalesce(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)), F.lit(0.0))).drop("p")


def flatten_columns(px: DataFrame, axis: str = "col") -> DataFrame:
    """``flat``: value minus its column's (or row's) median, which takes out a gradient across the range."""
    med = px.groupBy("scene_id", axis).agg(F.percentile("value", 0.5).alias("_m"))
    return px.join(med, ["scene_id", axis]).withColumn("flat", F.col("value") - F.col("_m")).drop("_m")


def sizes(px: DataFrame) -> DataFrame:
    """``scene_id, height, width``: one row per scene."""
    return px.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def by_blocks(px: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], halo: int, value: str, name: str, block: int = 256) -> DataFrame:
    """``px`` with ``name``: what ``kernel`` makes of blocks of a scene, as arrays with a halo.

    ``kernel`` gets the values (0 where pixels are missing) and which pixels there are, both with ``halo`` pixels around a
    block, mirrored at the scene's edges (the edge pixel repeated).  A pixel goes to its block and to those that it is in
    the halo of, so some 5 % are sent twice; a group is one block.
    """
    near = lambda axis: F.explode(F.sequence(F.greatest(F.floor((F.col(axis) - halo) / block), F.lit(0)).cast("int"), F.floor((F.col(axis) + halo) / block).cast("int")))
    df = px.select(*PIXEL, F.col(value).cast("double").alias("_v")).join(sizes(px), "scene_id").withColumn("_y", near("row")).withColumn("_x", near("col"))
    df = df.where((F.col("_y") * block < F.col("height")) & (F.col("_x") * block < F.col("width")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, h, w = (int(pdf[c].iloc[0]) for c in ("_y", "_x", "height", "width"))
        y0, x0 = max(0, y * block - halo), max(0, x * block - halo)
        y1, x1 = min(h, (y + 1) * block + halo), min(w, (x + 1) * block + halo)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        img, there = np.zeros((y1 - y0, x1 - x0)), np.zeros((y1 - y0, x1 - x0), bool)
        img[r - y0, c - x0] = pdf["_v"].to_numpy(float)
        there[r - y0, c - x0] = True
        # the halo that lies outside the scene
        pad = [(halo - (y * block - y0), halo - (y1 - min(h, (y + 1) * block))), (halo - (x * block - x0), halo - (x1 - min(w, (x + 1) * block)))]
        out = kernel(np.pad(img, pad, "symmetric"), np.pad(there, pad, "symmetric"))
        own = (r // block == y) & (c // block == x)
        at = r[own] - y * block, c[own] - x * block
        return pd.DataFrame({"scene_id": pdf["scene_id"].to_numpy()[own], "row": r[own], "col": c[own], "_out": out[halo:-halo, halo:-halo][at] if halo else out[at]})

    kind = px.schema["scene_id"].dataType.simpleString()
    found = df.groupBy("scene_id", "_y", "_x").applyInPandas(run, f"scene_id {kind}, row int, col int, _out double")
    return px.join(found.withColumnRenamed("_out", name), PIXEL)


def gaussian_smooth(px: DataFrame, sigma: float = 1.5, value: str = "value", truncate: float = 4.0) -> DataFrame:
    """``smooth``: separable Gaussian with mirrored edges (edge pixel repeated), rows first, then columns."""
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()

    def kernel(img: np.ndarray, there: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            # what a missing pixel would be is not passed on
            img = np.apply_along_axis(np.convolve, axis, np.where(there, img, 0), w, "same")
        return img

    return by_blocks(px, kernel, 2 * radius, value, "smooth")


def _window_sums(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over windows of ``size`` squared around each place; nothing beyond the array."""
    h = size // 2
    c = np.pad(np.pad(a, h).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def despeckle(px: DataFrame, kind: str = "median", size: int = 5, value: str = "value", damping: float = 2.0) -> DataFrame:
    """``despeckled``: a speckle filter over windows of ``size`` squared pixels (odd), the edge pixel repeated.

    ``median``; ``lee``: the window's mean, plus as much of the pixel's difference from it as the window's variance has of
    that and the scene's; ``frost``: between the pixel and a Gaussian by how rough the window is, relative to the
    roughest of the scene; ``nlm``: non-local means (see ``non_local_means``).  The scene's figures are aggregations made
    before blocks are.
    """
    if kind == "nlm":
        return non_local_means(px, value=value)
    if kind == "median":
        def median(img, there):
            views = np.lib.stride_tricks.sliding_window_view(np.pad(img, size // 2, "edge"), (size, size))
            return np.median(views, axis=(2, 3))

        return by_blocks(px, median, size // 2, value, "despeckled")

    def moments(img):
        n = _window_sums(np.ones_like(img), size)
        mean = _window_sums(img, size) / n
        return mean, np.maximum(_window_sums(img * img, size) / n - mean * mean, 0)

    if kind == "lee":
        mean = by_blocks(px, lambda img, there: moments(img)[0], size // 2, value, "_mean")
        both = stored(by_blocks(mean, lambda img, there: moments(img)[1], size // 2, value, "_var"), "speckle")
        whole = px.groupBy("scene_id").agg(F.var_pop(value).alias("_all"))
        k = F.col("_var") / (F.col("_var") + F.col("_all") + 1e-8)
        out = both.join(whole, "scene_id").withColumn("despeckled", F.col("_mean") + k * (F.col(value) - F.col("_mean")))
        return out.select(*px.columns, "despeckled")
    if kind == "frost":
        def rough(img, there):
            mean, var = moments(img)
            return damping * var / (mean * mean + 1e-8)

        half = size // 2
        w = np.exp(-0.5 * (np.arange(-half, half + 1) / max(1.0, size / 2)) ** 2)
        w /= w.sum()
        blur = lambda img, there: np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, img, w, "same"), w, "same")
        both = stored(by_blocks(by_blocks(px, rough, half, value, "_rough"), blur, size, value, "_blur"), "speckle")
        most = both.groupBy("scene_id").agg(F.max("_rough").alias("_most"))
        blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_rough") / (F.col("_most") + 1e-8)))
        out = both.join(most, "scene_id").withColumn("despeckled", blend * F.col(value) + (1 - blend) * F.col("_blur"))
        return out.select(*px.columns, "despeckled")
    raise ValueError(f"no speckle filter {kind!r}; there are median, lee, frost and nlm")


def patch_means(img: np.ndarray, h: float, template: int, search: int) -> np.ndarray:
    """Non-local means of the inner part of ``img``, which has ``template // 2 + search // 2`` pixels around it.

    For each shift inside the search window the squared differences of the image and the shifted image are summed over
    templates by an integral image, so a pixel costs the same for templates of any size.
    """
    t, s = template // 2, search // 2
    inner = img[s : img.shape[0] - s, s : img.shape[1] - s]  # with room for templates
    total, weights = np.zeros((inner.shape[0] - 2 * t, inner.shape[1] - 2 * t)), np.zeros((inner.shape[0] - 2 * t, inner.shape[1] - 2 * t))
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            other = img[s + dy : img.shape[0] - s + dy, s + dx : img.shape[1] - s + dx]
            c = np.pad(((inner - other) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            apart = (c[template:, template:] - c[:-template, template:] - c[template:, :-template] + c[:-template, :-template]) / template**2
            w = np.exp(-np.maximum(apart, 0) / h**2)
            total += w * other[t : other.shape[0] - t, t : other.shape[1] - t]
            weights += w
    return total / weights


def non_local_means(px: DataFrame, h: float = 10.0, template: int = 7, search: int = 21, value: str = "value", block: int = 256) -> DataFrame:
    """``despeckled``: each pixel as a mean of those around it, by how alike their surroundings are, in whole grey levels.

    Values are scaled to grey levels 0..255 between the scene's extremes first (an aggregation).  Blocks have a halo of half
    a search window and half a template, so they don't matter.
    """
    ends = px.groupBy("scene_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    grey = F.coalesce(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * 255, F.col("_hi") - F.col("_lo"))), F.lit(0)).cast("double")
    levels = px.join(ends, "scene_id").withColumn("_grey", grey).drop("_lo", "_hi")
    halo = search // 2 + template // 2

    def kernel(img: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.pad(np.rint(patch_means(img, h, template, search)), halo)

    return by_blocks(levels, kernel, halo, "_grey", "despeckled", block).drop("_grey")


def normalised(px: DataFrame, mean: float = 64.0, deviation: float = 32.0, value: str = "value") -> DataFrame:
    """``value`` as a predictor's input: cleaned, less the mean, over the deviation that it was trained with."""
    return clean_pixels(px.withColumn("value", F.col(value).cast("double"))).withColumn("value", (F.col("value") - mean) / deviation)


def otsu(px: DataFrame, by: list[str], value: str = "value", bins: int = 256) -> DataFrame:
    """``threshold`` of each group: centre of the first histogram bin with the largest variance between classes."""
    ends = px.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins).where("hi > lo")
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int"), F.lit(bins - 1))
    hist = px.join(ends, by).groupBy(*by, "lo", "width", at.alias("bin")).agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    hist = hist.withColumn("centre", centre)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("centre")).over(up)
    w, s = F.sum("n").over(whole), F.sum(F.col("n") * F.col("centre")).over(whole)
    df = hist.withColumn("w1", w1).withColumn("s1", s1).withColumn("w2", w - F.col("w1")).withColumn("s2", s - F.col("s1"))
    # between a bin and the next filled one the classes, and so the variance, stay the same: the first bin counts
    var = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.when(F.col("w2") > 0, F.col("w2")), 2)
    df = df.withColumn("var", var).where("var IS NOT NULL")
    return df.groupBy(*by).agg(F.max_by("centre", F.struct(F.col("var"), -F.col("bin"))).alias("threshold"))


def _corners(n: Column, tile: Column, stride: Column) -> Column:
    """Where tiles begin along an axis of length ``n``; the last one ends at the edge."""
    steps = F.sequence(F.lit(0), F.greatest(n - tile, F.lit(0)), stride)
    return F.when(F.element_at(steps, -1) + tile < n, F.concat(steps, F.array(n - tile))).otherwise(steps)


def tile_grid(scenes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Upper left corners of overlapping tiles of ``scene_id, height, width``; the last ones end at the edge."""
    along = lambda n: F.explode(_corners(F.col(n), F.lit(tile), F.lit(tile - overlap)))
    return scenes.withColumn("y", along("height")).withColumn("x", along("width")).select("scene_id", "y", "x")


def _corners_over(at: Column, n: Column, tile: Column, stride: Column) -> Column:
    """Of ``_corners``, those of the tiles that hold a place: by arithmetic, so a pixel meets its own tiles only."""
    last = F.floor(F.greatest(n - tile, F.lit(0)) / stride).cast("int")
    low = F.greatest(F.ceil((at - tile + 1) / stride).cast("int"), F.lit(0))
    high = F.least(F.floor(at / stride).cast("int"), last)
    some = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * stride).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when((last * stride + tile < n) & (at >= n - tile), F.concat(some, F.array((n - tile).cast("int")))).otherwise(some)


def in_tiles(px: DataFrame, tile: Column, stride: Column) -> DataFrame:
    """``px`` (with ``height, width``) once for each tile that a pixel lies in, with the tile's corner ``y, x``."""
    return px.withColumn("y", F.explode(_corners_over(F.col("row"), F.col("height"), tile, stride))).withColumn("x", F.explode(_corners_over(F.col("col"), F.col("width"), tile, stride)))


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """Overlapping predictions (``scene_id, row, col, p``) to their mean."""
    return tiles.groupBy(*PIXEL).agg(F.avg("p").alias("p"), F.count("*").alias("n_tiles"))


def predict_tiles(px: DataFrame, predict: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int) -> DataFrame:
    """Probability of each pixel: tiles as arrays through ``predict``, overlaps merged, small scenes mirrored to a tile.

    A group is one tile, ``tile`` squared pixels at most.
    """
    near = in_tiles(px.select(*PIXEL, "value").join(sizes(px), "scene_id"), F.lit(tile), F.lit(tile - overlap)).drop("height", "width")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = int(pdf["y"].iloc[0]), int(pdf["x"].iloc[0])
        r, c = pdf["row"].to_numpy() - y, pdf["col"].to_numpy() - x
        img = np.zeros((r.max() + 1, c.max() + 1), np.float32)
        img[r, c] = np.nan_to_num(pdf["value"].to_numpy(np.float32), nan=0.0, neginf=0.0)
        h, w = img.shape
        pad = [(0, tile - h), (0, tile - w)]
        full = np.pad(img, pad, "reflect" if min(h, w) > 1 and max(tile - h, tile - w) < min(h, w) else "symmetric" if min(h, w) > 1 else "edge") if (h, w) != (tile, tile) else img
        p = np.asarray(predict(full), np.float64)
        if p.shape != full.shape or not np.isfinite(p).all():
            raise ValueError(f"the predictor made {p.shape} of {full.shape}, or numbers that are not finite")
        p = p[:h, :w]
        return pd.DataFrame({"scene_id": pdf["scene_id"], "row": pdf["row"], "col": pdf["col"], "p": p[r, c]})

    kind = px.schema["scene_id"].dataType.simpleString()
    return merge_tiles(near.groupBy("scene_id", "y", "x").applyInPandas(run, f"scene_id {kind}, row int, col int, p double"))


def validate_predictor(spark: SparkSession, predict: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int) -> DataFrame:
    """One row per kind of scene (smaller than a tile, not square, exactly a tile, several tiles; with and without missing
    values): ``scene, ok``, whether each pixel got a probability from 0 to 1."""
    shapes = {"smaller": (max(1, tile // 2), max(1, tile // 2 + 3)), "not_square": (tile + 7, 2 * tile + 5), "exact": (tile, tile), "several": (2 * tile + 1, 2 * tile + 1)}
    px = None
    for name, (h, w) in shapes.items():
        noise = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1000)) / 10
        at = spark.range(h * w).select((F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"), noise.alias("value"))
        holes = F.when(~F.col("row").between(5, 8) | ~F.col("col").between(5, 8), F.col("value"))
        both = at.select(F.lit(name).alias("scene_id"), "row", "col", "value").union(at.select(F.lit(f"{name}_with_holes"), "row", "col", holes))
        px = both if px is None else px.union(both)
    got = px.join(predict_tiles(px, predict, tile, overlap), PIXEL, "left")
    return got.groupBy(F.col("scene_id").alias("scene")).agg(F.min(F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("ok"))


def _neighbours(px: DataFrame, flag: str) -> DataFrame:
    """For each pixel how many of the 9 in its 3x3 neighbourhood are set; outside the scene is background."""
    shift = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    set_ = px.where(flag).select("scene_id", "row", "col", shift.alias("s")).select("scene_id", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    return px.join(set_.groupBy(*PIXEL).agg(F.count("*").alias("_set")), PIXEL, "left").withColumn("_set", F.coalesce("_set", F.lit(0)))


def erode(px: DataFrame, flag: str = "mask") -> DataFrame:
    return _neighbours(px, flag).withColumn(flag, F.col("_set") == 9).drop("_set")


def dilate(px: DataFrame, flag: str = "mask") -> DataFrame:
    return _neighbours(px, flag).withColumn(flag, F.col("_set") > 0).drop("_set")


def open_close(px: DataFrame, flag: str = "mask") -> DataFrame:
    """3x3 opening, then closing."""
    return erode(dilate(dilate(erode(px, flag), flag), flag), flag)


def components(px: DataFrame, flag: str = "mask", connectivity: int = 8) -> DataFrame:
    """``scene_id, row, col, label`` of set pixels; a label is its component's smallest ``row * 2^20 + col``.

    Runs along rows are joined first (a window), so rounds pass labels between runs of neighbouring rows only; components
    of the runs' links are found in star steps (``graph.components``), all scenes at once.
    """
    row = Window.partitionBy("scene_id", "row").orderBy("col")
    on = px.where(flag).select(*PIXEL)
    on = on.withColumn("_run", F.col("col") - F.row_number().over(row))
    runs = on.groupBy("scene_id", "row", "_run").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = stored(runs.withColumn("id", F.struct("scene_id", (F.col("row").cast("long") * (1 << 20) + F.col("c0")).alias("at"))), "runs")
    reach = 1 if connectivity == 8 else 0
    # runs of neighbouring rows that touch; blocks of 64 columns make it an equality join
    block = lambda a, b: F.explode(F.sequence(F.floor(a / 64), F.floor(b / 64)))
    upper = runs.select("scene_id", (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("id").alias("u"), block(F.col("c0") - reach, F.col("c1") + reach).alias("blk"))
    lower = runs.select("scene_id", "row", "c0", "c1", F.col("id").alias("v"), block(F.col("c0"), F.col("c1")).alias("blk"))
    touch = upper.join(lower, ["scene_id", "row", "blk"]).where((F.col("a0") - reach <= F.col("c1")) & (F.col("c0") <= F.col("a1") + reach)).select("u", "v")
    labels = graph.components(touch).select(F.col("node").alias("id"), F.col("label.at").alias("label"))
    named = runs.join(labels, "id", "left").select("scene_id", "row", "_run", F.coalesce("label", "id.at").alias("label"))
    return on.join(named, ["scene_id", "row", "_run"]).select(*PIXEL, "label")


def seg_metrics(px: DataFrame, pred: str = "pred", truth: str = "gt", by: list[str] | None = None, eps: float = 1e-9) -> DataFrame:
    p, g = F.col(pred), F.col(truth)
    n = lambda c: F.sum(c.cast("double"))
    c = px.groupBy(*(by or ["scene_id"])).agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *(by or ["scene_id"]), (2 * tp / (2 * tp + fp + fn + eps)).alias("dice"), (tp / (tp + fp + fn + eps)).alias("iou"),
        (tp / (tp + fp + eps)).alias("precision"), (tp / (tp + fn + eps)).alias("recall"),
    )


def false_alarm_objects(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Components (``label``) without a pixel of the true mask (``scene_id, row, col, gt``), per scene."""
    hit = labelled.join(truth, PIXEL, "left").groupBy("scene_id", "label").agg(F.max(F.coalesce("gt", F.lit(False))).alias("hit"))
    return hit.groupBy("scene_id").agg(F.count_if(~F.col("hit")).alias("false_alarm_objects"))


def mask_agreement(px: DataFrame, a: str, b: str) -> DataFrame:
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return px.groupBy("scene_id").agg(both.alias("n_both"), either.alias("n_either"), (both / F.greatest(either, F.lit(1))).alias("iou"))


def pixel_area_km2(center_lat: Column, pixel_deg: float) -> Column:
    k = EARTH_RADIUS_M / 1000 * np.pi / 180
    return F.pow(F.lit(pixel_deg * k), 2) * F.cos(F.radians(center_lat))


def component_evidence(px: DataFrame, labelled: DataFrame, pixel_km2: float, probability: str | None = None, *, least_km2: float = 0.05, keep_ratio: float = 0.4) -> DataFrame:
    """``scene_id, label, n_pixels, area_km2, evidence, oil_score, kept`` of components with enough area.

    Evidence is the mean probability, or how many times 6 dB a component is darker than the sea around (``px``: ``db``
    and ``mask``); components with ``keep_ratio`` of the best score are kept.
    """
    sea = exact_percentiles(px, ["scene_id"], F.when(~F.col("mask"), F.col("db")), (0.5,)).select("scene_id", F.col("p")[0].alias("sea"))
    value = F.avg(probability) if probability else F.greatest(F.max("sea") - F.avg("db"), F.lit(0.0)) / 6
    c = labelled.join(px, PIXEL).join(sea, "scene_id", "left").groupBy("scene_id", "label").agg(F.count("*").alias("n_pixels"), value.alias("evidence"))
    c = c.withColumn("area_km2", F.col("n_pixels") * pixel_km2).where(F.col("area_km2") >= least_km2)
    c = c.withColumn("oil_score", F.col("area_km2") * F.col("evidence"))
    return c.withColumn("kept", F.col("oil_score") >= keep_ratio * F.max("oil_score").over(Window.partitionBy("scene_id")))


def slick_axes(pixels: DataFrame) -> DataFrame:
    """Centre and principal axes of ``scene_id, lon, lat``: full lengths of two deviations each side, bearing of the longer.

    Eigenvalues and the direction of a 2x2 sample covariance have a closed form.
    """
    c = pixels.groupBy("scene_id").agg(F.avg("lon").alias("center_lon"), F.avg("lat").alias("center_lat"))
    x, y = local_km("lon", "lat", "center_lon", "center_lat")
    m = pixels.join(c, "scene_id").withColumn("_x", x).withColumn("_y", y).groupBy("scene_id", "center_lon", "center_lat").agg(
        F.var_samp("_x").alias("xx"), F.var_samp("_y").alias("yy"), F.covar_samp("_x", "_y").alias("xy"), F.count("*").alias("n_pixels"))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    bearing = F.pmod(F.degrees(F.atan2(2 * F.col("xy"), F.col("yy") - F.col("xx")) / 2), F.lit(180.0))
    enough = F.col("n_pixels") > 3
    axis = lambda ev: F.when(enough, 4 * F.sqrt(F.greatest(ev, F.lit(0.0)))).otherwise(0.0)
    return m.select("scene_id", "n_pixels", "center_lon", "center_lat", axis(half + root).alias("major_km"), axis(half - root).alias("minor_km"), F.when(enough, bearing).alias("orientation_deg"))


def detect_dark(px: DataFrame, mode: str = "tiled", *, window: int = 96, gate_db: float = 3.0, smooth_px: float = 1.5, least_pixels: int = 30) -> DataFrame:
    """``mask``: dark objects by Otsu thresholds, in sliding windows that are truly bimodal or (``global``) in the scene.

    ``px`` has ``value`` in decibels.  Missing pixels count as the scene's median and are never dark.
    """
    med = exact_percentiles(px, ["scene_id"], F.col("value"), (0.5,)).select("scene_id", F.col("p")[0].alias("_m"))
    known = px.join(med, "scene_id").withColumn("valid", F.col("value").isNotNull()).withColumn("value", F.coalesce("value", "_m")).drop("_m")
    flat = flatten_columns(known).drop("value").withColumnRenamed("flat", "value")
    sm = stored(gaussian_smooth(flat, smooth_px), "smooth")
    if mode == "global":
        thr = otsu(sm.where("valid"), ["scene_id"], "smooth")
        dark = sm.join(thr, "scene_id").withColumn("mask", (F.col("smooth") < F.col("threshold")) & F.col("valid"))
    else:
        one = sizes(sm).withColumn("w", F.least(F.lit(window), "height", "width"))
        win = in_tiles(sm.join(one, "scene_id"), F.col("w"), F.greatest(F.floor(F.col("w") / 2).cast("int"), F.lit(1))).drop("height", "width", "w")
        by = ["scene_id", "y", "x"]
        thr = otsu(win, by, "smooth")
        low = F.col("smooth") < F.col("threshold")
        ok = win.join(thr, by).groupBy(*by, "threshold").agg(
            F.avg(low.cast("double")).alias("frac"), (F.avg(F.when(~low, F.col("smooth"))) - F.avg(F.when(low, F.col("smooth")))).alias("contrast"), (F.max("smooth") - F.min("smooth")).alias("ptp"))
        ok = ok.where((F.col("ptp") >= 1e-6) & F.col("frac").between(0.01, 0.6) & (F.col("contrast") >= gate_db))
        hits = win.join(ok, by).where(low).select(*PIXEL).distinct().withColumn("_h", F.lit(True))
        dark = sm.join(hits, PIXEL, "left").withColumn("mask", F.coalesce("_h", F.lit(False)) & F.col("valid")).drop("_h")
    dark = stored(open_close(dark.select(*PIXEL, "mask")), "dark")
    lab = components(dark, connectivity=4)
    big = lab.groupBy("scene_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least_pixels)
    kept = lab.join(big, ["scene_id", "label"], "left_semi").select(*PIXEL).withColumn("_k", F.lit(True))
    return px.join(kept, PIXEL, "left").withColumn("mask", F.coalesce("_k", F.lit(False))).drop("_k")


def select_detector(summary: DataFrame, mode: str = "auto", network_available: bool = True, *, margin: float = 0.02, when_tied: str = "deeplab", by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, detector, reason`` from mean Dice values of ``otsu`` and ``deeplab`` (``summary``: ``*by, detector, dice``); one row, or
    one for each group."""
    dice = lambda name: F.max(F.when(F.col("detector") == name, F.col("dice")))
    d = summary.groupBy(*by).agg(dice("deeplab").alias("n"), dice("otsu").alias("o"))
    if mode in ("otsu", "deeplab"):
        name = mode if mode == "otsu" or network_available else "otsu"
        return d.select(*by, F.lit(name).alias("detector"), F.lit("forced" if name == mode else "forced_but_unavailable").alias("reason"))
    if not network_available:
        return d.select(*by, F.lit("otsu").alias("detector"), F.lit("network_unavailable").alias("reason"))
    gap = F.col("n") - F.col("o")
    pick = F.when(F.col("n").isNull(), F.struct(F.lit("deeplab").alias("d"), F.lit("not_benchmarked").alias("r")))
    pick = pick.when(F.col("o").isNull(), F.struct(F.lit("deeplab").alias("d"), F.lit("otsu_not_benchmarked").alias("r")))
    pick = pick.when(gap > margin, F.struct(F.lit("deeplab").alias("d"), F.lit("better").alias("r")))
    pick = pick.when(-gap > margin, F.struct(F.lit("otsu").alias("d"), F.lit("better").alias("r")))
    pick = pick.otherwise(F.struct(F.lit(when_tied).alias("d"), F.lit("within_margin").alias("r")))
    return d.select(*by, pick.alias("p")).select(*by, F.col("p.d").alias("detector"), F.col("p.r").alias("reason"))

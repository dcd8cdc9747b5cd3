"""From a mask to a slick: which components count, where it lies, and particles drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slickwake.functions.geo import EARTH_RADIUS_M, pixel_to_lonlat
from slickwake.operators import graph, raster
from slickwake.sources.scratch import stored


def pixel_sides_km(pixel_deg: float, lat: float) -> tuple[float, float]:
    from math import cos, pi, radians

    k = EARTH_RADIUS_M / 1000 * pi / 180 * pixel_deg
    return k * cos(radians(lat)), k


def observe(px: DataFrame, grid: dict, probability: str | None = None, **evidence) -> tuple[dict | None, DataFrame, DataFrame]:
    """(the slick of one scene, its components, its pixels) of ``scene_id, row, col, db, mask``; None without a component that counts.

    ``grid``: ``west, north, pixel_deg, height, width`` of the scene; ``evidence``: settings of ``raster.component_evidence``.
    """
    dx, dy = pixel_sides_km(grid["pixel_deg"], grid["north"] - grid["height"] / 2 * grid["pixel_deg"])
    labelled = stored(raster.components(px.select(*raster.PIXEL, "mask")), "labelled")
    found = stored(raster.component_evidence(px, labelled, dx * dy, probability, **evidence), "evidence")
    lon, lat = pixel_to_lonlat("row", "col", grid["west"], grid["north"], grid["pixel_deg"])
    kept = found.where("kept").select("scene_id", "label")
    pixels = stored(labelled.join(kept, ["scene_id", "label"], "left_semi").withColumn("lon", lon).withColumn("lat", lat), "slick")
    row = raster.slick_axes(pixels).first()
    if row is None:
        return None, found, pixels
    obs = row.asDict() | {"area_km2": row["n_pixels"] * dx * dy, "pixel_km2": dx * dy}
    return obs, found, pixels


def rings(pixels: DataFrame) -> DataFrame:
    """Outlines of components (``scene_id, label, row, col``) as rings of corners: ``scene_id, label, ring, n, row, col``.

    ``row, col`` count pixel edges.  Sides run clockwise around pixels; those that two pixels share cancel by aggregation.
    Where two pixels touch by a corner only, the outline goes over to the other pixel (components are 8-connected).
    Order along the outline is list ranking (``graph.ring_places``), so no task holds a ring.  Ring 0 is the largest, the
    outer one; a ring begins at its smallest corner.
    """
    key = ["scene_id", "label"]
    r, c = F.col("row"), F.col("col")
    side = lambda r0, c0, dr, dc: F.struct(r0.cast("long").alias("r0"), c0.cast("long").alias("c0"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
    sides = F.explode(F.array(side(r, c, 0, 1), side(r, c + 1, 1, 0), side(r + 1, c + 1, 0, -1), side(r + 1, c, -1, 0)))
    each = pixels.select(*key, sides.alias("s")).select(*key, "s.*").withColumn("r1", F.col("r0") + F.col("dr")).withColumn("c1", F.col("c0") + F.col("dc"))
    ends = [F.least(F.col(f"{x}0"), F.col(f"{x}1")).alias(f"_{x}") for x in "rc"]
    lone = each.groupBy(*key, *ends, F.abs("dr").alias("_up")).agg(F.count("*").alias("_k"), *(F.first(x).alias(x) for x in ("r0", "c0", "r1", "c1", "dr", "dc"))).where("_k = 1")
    # in the order of starts, then of directions
    place = F.struct("r0", "c0", "dr", "dc")
    lone = stored(lone.select(F.struct(*key, place.alias("at")).alias("id"), *key, "r0", "c0", "r1", "c1", "dr", "dc"), "sides")
    after = lone.select(F.col("id").alias("next"), *(F.col(k).alias(f"_{k}") for k in key), F.col("r0").alias("_r0"), F.col("c0").alias("_c0"), F.col("dr").alias("_dr"), F.col("dc").alias("_dc"))
    met = lone.join(after, [lone[k] == after[f"_{k}"] for k in key] + [lone["r1"] == after["_r0"], lone["c1"] == after["_c0"]])
    # of two ways on, the left turn
    left = (F.col("_dr") == -F.col("dc")) & (F.col("_dc") == F.col("dr"))
    turns = (F.col("_dr") != F.col("dr")) | (F.col("_dc") != F.col("dc"))
    onward = met.groupBy("id").agg(F.max_by(F.struct("next", turns.alias("turns")), F.when(left, 2).otherwise(F.when(~turns, 1).otherwise(0))).alias("n"))
    onward = stored(onward.select("id", F.col("n.next").alias("next"), F.col("n.turns").alias("turns")), "onward")
    corner = onward.select(F.col("next").alias("id"), F.col("turns").alias("corner"))
    nodes = stored(onward.join(corner, "id").select("id", "next", "corner"), "nodes")
    placed = graph.ring_places(nodes, F.col("corner")).join(nodes.select("id", "corner"), "id")
    x0, y0 = F.col("id.at.c0"), F.col("id.at.r0")
    area = F.abs(F.sum(x0 * (y0 + F.col("id.at.dr")) - (x0 + F.col("id.at.dc")) * y0))
    sizes = placed.groupBy("ring").agg((F.max("ahead") + 1).alias("corners"), area.alias("area"))
    # one row for each ring
    order = Window.partitionBy("ring.scene_id", "ring.label").orderBy(F.desc("area"), "ring")
    numbered = sizes.withColumn("number", F.row_number().over(order) - 1)
    out = placed.where("corner").join(numbered, "ring")
    n = F.when(F.col("id") == F.col("ring"), 0).otherwise(F.col("corners") - F.col("ahead")).cast("int")
    return out.select(*(F.col(f"id.{k}").alias(k) for k in key), F.col("number").alias("ring"), n.alias("n"), y0.cast("int").alias("row"), x0.cast("int").alias("col"))


def outline(pixels: DataFrame, grid: dict) -> DataFrame:
    """The slick's largest component as rings of corners: ``scene_id, label, ring, n, lon, lat``; ring 0 is the outer one."""
    size = pixels.groupBy("scene_id", "label").agg(F.count("*").alias("size"))
    big = size.groupBy("scene_id").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("label"))
    lon, lat = pixel_to_lonlat(F.col("row") - 0.5, F.col("col") - 0.5, grid["west"], grid["north"], grid["pixel_deg"])
    return rings(pixels.join(big, ["scene_id", "label"], "left_semi")).select("scene_id", "label", "ring", "n", lon.alias("lon"), lat.alias("lat"))


def sample_particles(pixels: DataFrame, n: int, grid: dict, seed: int, weight: str | None = None) -> DataFrame:
    """``particle, lon0, lat0``: ``n`` draws with replacement by weight, each moved inside its pixel.

    A draw falls on the pixel whose stretch of the running sum of weights holds it.  Draws meet the stretches of whole
    rows first (a scene has some thousands), and then those of pixels inside their row, so no task orders the slick.
    """
    spark = pixels.sparkSession
    w = F.greatest(F.col(weight), F.lit(1e-6)) if weight else F.lit(1.0)
    weights = pixels.select("row", "col", w.alias("w"))
    sums = weights.groupBy("row").agg(F.sum("w").alias("row_w"))
    above = F.sum("row_w").over(Window.orderBy("row")) - F.col("row_w")  # one row for each row of the scene
    sums = sums.withColumn("above", above).withColumn("all", F.sum("row_w").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 40)) / float(1 << 40)
    draws = spark.range(n).select(unit(1).alias("at"), F.col("id").alias("particle"), unit(2).alias("dr"), unit(3).alias("dc"))
    behind = lambda *by: Window.partitionBy(*by).orderBy("at", F.col("particle").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # rows and draws: as many as a scene is high, and n
    rows = sums.select((F.col("above") / F.col("all")).alias("at"), "row").unionByName(draws, allowMissingColumns=True)
    rows = rows.withColumn("row", F.last("row", ignorenulls=True).over(behind())).where("particle IS NOT NULL")
    left = F.sum("w").over(Window.partitionBy("row").orderBy("col")) - F.col("w")
    stretches = weights.withColumn("left", left).join(sums, "row").select("row", "col", ((F.col("above") + F.col("left")) / F.col("all")).alias("at"))
    both = stretches.unionByName(rows, allowMissingColumns=True)
    hit = both.withColumn("c", F.coalesce(F.last("col", ignorenulls=True).over(behind("row")), F.first("col", ignorenulls=True).over(behind("row")))).where("particle IS NOT NULL")
    lon, lat = pixel_to_lonlat(F.col("row") + F.col("dr") - 0.5, F.col("c") + F.col("dc") - 0.5, grid["west"], grid["north"], grid["pixel_deg"])
    return hit.select("particle", lon.alias("lon0"), lat.alias("lat0"))


def detect_in_order(px: DataFrame, detectors: dict, selected: str, grid: dict, **evidence) -> tuple[dict | None, dict]:
    """Run the selected detector and then the others; the first that yields a slick counts, all report their masks.

    A detector is a function from pixels to pixels with ``mask``.  The second value has what was used, whether another
    stepped in, and the overlap of the first two masks.
    """
    order = [selected, *(d for d in detectors if d != selected)]
    masks = {name: stored(detectors[name](px), "mask") for name in order}
    used = obs = found = pixels = None
    for name in order:
        obs, found, pixels = observe(masks[name], grid, **evidence)
        if obs is not None:
            used = name
            break
    overlap = None
    if len(order) > 1:
        a, b = (masks[n].select(*raster.PIXEL, F.col("mask").alias(f"m{i}")) for i, n in enumerate(order[:2]))
        overlap = raster.mask_agreement(a.join(b, raster.PIXEL), "m0", "m1").first()["iou"]
    return obs, {"selected": selected, "used": used, "fell_back": used is not None and used != selected, "inter_detector_iou": overlap, "components": found, "pixels": pixels, "masks": masks}

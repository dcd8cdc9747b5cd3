"""Queries over pixel tables and detector results, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.functions import geo
from slickwake.operators import raster
from slickwake.plans import views
from slickwake.plans.reports_queries import _r, rounded
from slickwake.plans.views import BLOBS_SQL, PIXELS_SQL
from slickwake.sources.scratch import stored

PX = raster.PIXEL


def column_flatten(spark, sf_dir):
    return rounded(raster.flatten_columns(views.pixels(spark, sf_dir)).select(*PX, "flat"), 7)


def db_stretch(spark, sf_dir):
    return rounded(raster.stretch(views.pixels(spark, sf_dir)).select(*PX, "db", "scaled"), 7)


def clean_pixels(spark, sf_dir):
    """Scenes with missing and infinite values."""
    v = "CASE WHEN (row + col) % 17 = 0 THEN double('NaN') WHEN (row + col) % 19 = 0 THEN double('Infinity') WHEN (row + col) % 23 = 0 THEN double('-Infinity') WHEN (row + col) % 29 = 0 THEN NULL ELSE value END"
    return rounded(raster.clean_pixels(views.pixels(spark, sf_dir).withColumn("value", F.expr(v))).select(*PX, "value"), 7)


def gaussian_smooth(spark, sf_dir):
    return rounded(raster.gaussian_smooth(views.pixels(spark, sf_dir), 1.5).select(*PX, "smooth"), 6)


def otsu_threshold(spark, sf_dir):
    return rounded(raster.otsu(views.pixels(spark, sf_dir), ["scene_id"]), 4)


def tile_grid(spark, sf_dir):
    s = views.table(spark, sf_dir, "part").selectExpr("p_partkey AS scene_id", "CAST(20 + p_partkey * 13 % 640 AS INT) AS height", "CAST(30 + p_partkey * 29 % 1450 AS INT) AS width")
    return raster.tile_grid(s, 256, 32)


def tile_merge(spark, sf_dir):
    """Predictions of overlapping 32-pixel tiles (a tile's prediction is an arithmetic of pixel and corner)."""
    px = views.pixels(spark, sf_dir).select(*PX)
    t = raster.in_tiles(px.withColumns({"height": F.lit(64), "width": F.lit(64)}), F.lit(32), F.lit(24))
    return rounded(raster.merge_tiles(t.withColumn("p", F.expr("((row * 3 + col * 5 + y + x) % 101) / 101D"))))


def tile_inference(spark, sf_dir):
    """Tiles as arrays through a stub predictor (brighter than the tile's mean), overlaps merged."""
    px = views.pixels(spark, sf_dir)
    return rounded(raster.predict_tiles(px, lambda t: (t > t.mean()).astype(float), 32, 8).select(*PX, "p", "n_tiles"))


def morphology(spark, sf_dir):
    return raster.open_close(views.blobs(spark, sf_dir).select(*PX, "mask"))


def connected_components(spark, sf_dir):
    lab = raster.components(views.blobs(spark, sf_dir).select(*PX, "mask"), connectivity=8)
    return lab.groupBy("scene_id", "label").agg(F.count("*").alias("n_pixels"), F.min("col").alias("col_min"), F.max("row").alias("row_max"))


def connected_components_4(spark, sf_dir):
    lab = raster.components(views.blobs(spark, sf_dir).select(*PX, "mask"), connectivity=4)
    return lab.groupBy("scene_id", "label").agg(F.count("*").alias("n_pixels"))


def component_evidence(spark, sf_dir):
    px = views.blobs(spark, sf_dir).withColumn("db", 10 * F.log10("value"))
    lab = raster.components(px.select(*PX, "mask"))
    return rounded(raster.component_evidence(px, lab, 0.004, least_km2=0.02))


def slick_axes(spark, sf_dir):
    lon, lat = geo.pixel_to_lonlat("row", "col", 32.0, 31.8, 0.0009)
    return rounded(raster.slick_axes(views.blobs(spark, sf_dir).where("mask AND col < row").select("scene_id", lon.alias("lon"), lat.alias("lat"))), 5)


def seg_metrics(spark, sf_dir):
    return rounded(raster.seg_metrics(views.pixels(spark, sf_dir)))


def label_metrics(spark, sf_dir):
    """Confusion of two label columns: quality as truth, not toxic as prediction."""
    lb = views.table(spark, sf_dir, "labels").selectExpr("1 AS scene_id", "toxic = 0 AS pred", "quality = 1 AS gt")
    return rounded(raster.seg_metrics(lb))


def false_alarm_objects(spark, sf_dir):
    px = views.blobs(spark, sf_dir)
    lab = raster.components(px.select(*PX, "mask"))
    return raster.false_alarm_objects(lab, px.select(*PX, (F.col("gt") & ((F.col("row") + F.col("col")) % 29 == 0)).alias("gt")))


def mask_agreement(spark, sf_dir):
    return rounded(raster.mask_agreement(views.pixels(spark, sf_dir), "pred", "gt"))


def mask_set_operations(spark, sf_dir):
    """Intersection, union and difference of two masks as sets of pixels."""
    px = views.pixels(spark, sf_dir)
    a, b = px.where("pred").select(*PX), px.where("gt").select(*PX)
    parts = [("and", a.intersect(b)), ("or", a.union(b).distinct()), ("minus", a.exceptAll(b))]
    out = None
    for name, p in parts:
        n = p.groupBy("scene_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(name))
        out = n if out is None else out.union(n)
    return out


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of detectors on scenes: a stand-in from documents, by source and language."""
    d = views.table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("scene"), F.col("lang").alias("detector")).agg(
        (F.avg("n_chars") / 10_000).alias("dice"), F.count("*").alias("n"), F.min("n_chars").alias("low"))


def detector_benchmark(spark, sf_dir):
    return rounded(_bench(spark, sf_dir).groupBy("detector").agg(F.avg("dice").alias("dice"), F.avg("low").alias("low"), F.count("*").alias("scenes")))


def detector_select(spark, sf_dir):
    """The detector that wins in each scene: sources of documents, the English ones as one detector's results, others as the other's."""
    d = views.table(spark, sf_dir, "documents")
    scores = d.groupBy(F.col("source").alias("scene"), F.when(F.col("lang") == "en", "deeplab").otherwise("otsu").alias("detector")).agg((F.avg("n_chars") / 10_000).alias("dice"))
    return raster.select_detector(scores, by=("scene",))


def image_mask_pairs(spark, sf_dir):
    """Images and masks by file stem; of masks with one stem the last counts."""
    from slickwake.sources.scenes import pair_by_stem

    p = views.table(spark, sf_dir, "pages").selectExpr("page_id AS ord", "concat('/data/', CASE WHEN page_id % 3 = 0 THEN 'masks' WHEN page_id % 5 = 0 THEN 'Test' ELSE 'img' END, '/s', CAST(page_id % 40 AS STRING), CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.tif' END) AS path")
    return pair_by_stem(p)


def acquisition_times(spark, sf_dir):
    """Acquisition time of scenes from their tags: an override, then tags in order, else none."""
    from slickwake.sources.scenes import acquisition_time

    e = views.table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN '2024-05-01 10:00:00' END AS override",
        "CASE WHEN event_id % 3 = 0 THEN map('SENSING_TIME', date_format(ts, 'yyyy-MM-dd HH:mm:ss')) WHEN event_id % 3 = 1 THEN map('tifftag_datetime', date_format(ts, 'yyyy:MM:dd HH:mm:ss'), 'other', 'x') ELSE map('other', 'x') END AS tags")
    t, src = acquisition_time("override", "tags")
    return e.select("event_id", t.alias("t"), src.alias("time_source")).select("event_id", geo.epoch_s("t").alias("es"), "time_source")


def scene_units(spark, sf_dir):
    """Units of scenes from type and range of values."""
    from slickwake.sources.scenes import infer_units

    px = views.pixels(spark, sf_dir).withColumn("k", F.col("row") % 4).selectExpr(
        "k AS scene_id", "CASE k WHEN 0 THEN 'uint8' ELSE 'float32' END AS dtype", "CASE k WHEN 1 THEN value / 1e6 WHEN 2 THEN -value / 1e4 ELSE value END AS value")
    return infer_units(px)


def case_summary(spark, sf_dir):
    """One row per case, with cases without a slick by name only."""
    from slickwake.plans.case import summary

    s = views.table(spark, sf_dir, "supplier")
    found = s.where("s_suppkey % 4 <> 0").selectExpr("concat('case_', s_suppkey) AS case_id", "'OK' AS status", "s_acctbal / 1000 AS area_km2", "s_nationkey AS n_candidates")
    none = s.where("s_suppkey % 4 = 0").selectExpr("concat('case_', s_suppkey) AS case_id", "'NO_OIL_DETECTED' AS status")
    return rounded(summary([found, none]).select("case_id", "status", "area_km2", "n_candidates"))


def otsu_tiled(spark, sf_dir):
    """Dark objects of two scenes in decibels, in which patches are 8 dB darker: their number and size, and how well they match
    (no SQL counterpart; the tests hold thresholds, components and filters)."""
    px = views.pixels(spark, sf_dir).withColumn("gt", F.expr("pmod(row - 6 * scene_id, 32) < 12 AND pmod(col + row DIV 32 * 9, 40) < 14"))
    px = px.select(*PX, (10 * F.log10("value") - F.when(F.col("gt"), 8.0).otherwise(0.0)).alias("value"), "gt")
    found = stored(raster.detect_dark(px, window=48).withColumnRenamed("mask", "pred"), "found")
    objects = raster.components(found, "pred", connectivity=4).groupBy("scene_id").agg(F.countDistinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))
    return rounded(raster.seg_metrics(found).join(objects, "scene_id", "left"), 3)


QUERIES = {f.__name__: f for f in (
    column_flatten, db_stretch, clean_pixels, gaussian_smooth, otsu_threshold, tile_grid, tile_merge, tile_inference, morphology, connected_components,
    connected_components_4, component_evidence, slick_axes, seg_metrics, label_metrics, false_alarm_objects, mask_agreement, mask_set_operations,
    detector_benchmark, detector_select, image_mask_pairs, acquisition_times, scene_units, case_summary, otsu_tiled)}


def _cc(rows: str, reach8: bool) -> str:
    """Components by propagating minimal labels in a recursive query over runs of each row."""
    r = "+ 1" if reach8 else ""
    return f"""{rows}, on_px AS (SELECT scene_id, "row", col, col - row_number() OVER (PARTITION BY scene_id, "row" ORDER BY col) AS g FROM bl WHERE mask),
      runs AS (SELECT scene_id, "row", min(col) AS c0, max(col) AS c1, "row" * 1048576::BIGINT + min(col) AS id, count(*) AS n FROM on_px GROUP BY scene_id, "row", g),
      lk AS (SELECT a.scene_id, a.id AS u, b.id AS v FROM runs a JOIN runs b ON a.scene_id = b.scene_id AND abs(a."row" - b."row") = 1 AND a.c0 <= b.c1 {r} AND b.c0 <= a.c1 {r}),
      reach(scene_id, src, id) AS (SELECT scene_id, id, id FROM runs UNION SELECT r.scene_id, r.src, lk.v FROM reach r JOIN lk ON r.scene_id = lk.scene_id AND r.id = lk.u),
      lab AS (SELECT runs.*, l.label FROM runs JOIN (SELECT scene_id, id, min(src) AS label FROM reach GROUP BY 1, 2) l ON runs.scene_id = l.scene_id AND runs.id = l.id)"""


_CORNERS = "(SELECT unnest([0, 24, 32]) AS {c})"
_GAUSS = """WITH {px}, base AS (SELECT scene_id, "row", col, value AS v FROM px),
  k0 AS (SELECT d, exp(-0.5 * (d / 1.5) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS d)), k AS (SELECT d, w / sum(w) OVER () AS w FROM k0),
  nr AS (SELECT scene_id, max("row") + 1 AS n FROM base GROUP BY 1), nc AS (SELECT scene_id, max(col) + 1 AS n FROM base GROUP BY 1),
  a AS (SELECT b.scene_id, b."row", b.col, k.w, CASE WHEN b."row" + d < 0 THEN -(b."row" + d) - 1 WHEN b."row" + d >= n THEN 2 * n - 1 - (b."row" + d) ELSE b."row" + d END AS src FROM base b JOIN nr USING (scene_id), k),
  h AS (SELECT a.scene_id, a."row", a.col, sum(a.w * b.v) AS v FROM a JOIN base b ON b.scene_id = a.scene_id AND b."row" = a.src AND b.col = a.col GROUP BY 1, 2, 3),
  c AS (SELECT b.scene_id, b."row", b.col, k.w, CASE WHEN b.col + d < 0 THEN -(b.col + d) - 1 WHEN b.col + d >= n THEN 2 * n - 1 - (b.col + d) ELSE b.col + d END AS src FROM base b JOIN nc USING (scene_id), k)
  SELECT c.scene_id, c."row", c.col, round(sum(c.w * h.v), 6) AS smooth FROM c JOIN h ON h.scene_id = c.scene_id AND h.col = c.src AND h."row" = c."row" GROUP BY 1, 2, 3"""
_MORPH = "SELECT scene_id, \"row\", col, {f} FROM (SELECT x.scene_id, x.\"row\", x.col, count(y.m) FILTER (WHERE y.m) AS n FROM {t} x LEFT JOIN {t} y ON x.scene_id = y.scene_id AND abs(x.\"row\" - y.\"row\") <= 1 AND abs(x.col - y.col) <= 1 GROUP BY 1, 2, 3)"
_ER, _DI = "n = 9 AS m", "n > 0 AS m"
SQL = {
    "column_flatten": f'WITH {PIXELS_SQL} SELECT scene_id, "row", col, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY scene_id, col), 7) AS flat FROM px',
    "db_stretch": f"""WITH {PIXELS_SQL}, d AS (SELECT *, 10 * log10(greatest(value, 1e-6)) AS db FROM px), p AS (SELECT scene_id, quantile_cont(db, 0.01) AS lo, quantile_cont(db, 0.995) AS hi FROM d GROUP BY 1)
      SELECT d.scene_id, "row", col, round(db, 7) AS db, round(least(255, greatest(0, (db - lo) / greatest(hi - lo, 1e-6) * 255)), 7) AS scaled FROM d JOIN p ON d.scene_id = p.scene_id""",
    "clean_pixels": f"""WITH {PIXELS_SQL}, f AS (SELECT *, CASE WHEN ("row" + col) % 17 = 0 THEN 1 WHEN ("row" + col) % 19 = 0 THEN 2 WHEN ("row" + col) % 23 = 0 THEN 3 WHEN ("row" + col) % 29 = 0 THEN 1 ELSE 0 END AS kind FROM px)
      SELECT scene_id, "row", col, round(CASE kind WHEN 0 THEN value WHEN 2 THEN max(CASE WHEN kind = 0 THEN value END) OVER (PARTITION BY scene_id) ELSE 0 END, 7) AS value FROM f""",
    "gaussian_smooth": _GAUSS.format(px=PIXELS_SQL),
    "otsu_threshold": f"""WITH {PIXELS_SQL}, e AS (SELECT scene_id, min(value) AS lo, (max(value) - min(value)) / 256 AS w FROM px GROUP BY 1),
      h AS (SELECT px.scene_id, lo, w, least(CAST(floor((value - lo) / w) AS INT), 255) AS b, count(*) AS n FROM px JOIN e ON px.scene_id = e.scene_id GROUP BY ALL),
      c AS (SELECT scene_id, b, lo + (b + 0.5) * w AS x, sum(n) OVER u AS w1, sum(n * (lo + (b + 0.5) * w)) OVER u AS s1, sum(n) OVER (PARTITION BY scene_id) AS wt, sum(n * (lo + (b + 0.5) * w)) OVER (PARTITION BY scene_id) AS st FROM h WINDOW u AS (PARTITION BY scene_id ORDER BY b ROWS UNBOUNDED PRECEDING))
      SELECT scene_id, round(arg_max(x, w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) ** 2), 4) AS threshold FROM c WHERE wt > w1 GROUP BY 1""",
    "tile_grid": """WITH s AS (SELECT p_partkey AS scene_id, 20 + p_partkey * 13 % 640 AS h, 30 + p_partkey * 29 % 1450 AS w FROM part),
      ys AS (SELECT scene_id, unnest(list_distinct(list_append(range(0, greatest(h - 256, 0) + 1, 224), greatest(h - 256, 0)))) AS y FROM s), xs AS (SELECT scene_id, unnest(list_distinct(list_append(range(0, greatest(w - 256, 0) + 1, 224), greatest(w - 256, 0)))) AS x FROM s)
      SELECT ys.scene_id, y, x FROM ys JOIN xs ON ys.scene_id = xs.scene_id""",
    "tile_merge": f"""WITH {PIXELS_SQL} SELECT scene_id, "row", col, round(avg((("row" * 3 + col * 5 + y + x) % 101) / 101.0::DOUBLE), 6) AS p, count(*) AS n_tiles FROM px, {_CORNERS.format(c='y')}, {_CORNERS.format(c='x')}
      WHERE "row" >= y AND "row" < y + 32 AND col >= x AND col < x + 32 GROUP BY 1, 2, 3""",
    "morphology": f"""WITH {BLOBS_SQL}, m0 AS (SELECT scene_id, "row", col, mask AS m FROM bl), m1 AS ({_MORPH.format(f=_ER, t='m0')}), m2 AS ({_MORPH.format(f=_DI, t='m1')}), m3 AS ({_MORPH.format(f=_DI, t='m2')}), m4 AS ({_MORPH.format(f=_ER, t='m3')})
      SELECT scene_id, "row", col, m AS mask FROM m4""",
    "connected_components": f'WITH RECURSIVE {_cc(BLOBS_SQL, True)} SELECT scene_id, label, CAST(sum(n) AS BIGINT) AS n_pixels, min(c0) AS col_min, max("row") AS row_max FROM lab GROUP BY 1, 2',
    "connected_components_4": f"WITH RECURSIVE {_cc(BLOBS_SQL, False)} SELECT scene_id, label, CAST(sum(n) AS BIGINT) AS n_pixels FROM lab GROUP BY 1, 2",
    "component_evidence": f"""WITH RECURSIVE {_cc(BLOBS_SQL, True)}, sea AS (SELECT scene_id, quantile_cont(10 * log10(value), 0.5) AS sea FROM bl WHERE NOT mask GROUP BY 1),
      ev AS (SELECT lab.scene_id, label, count(*) AS n_pixels, greatest(max(sea) - avg(10 * log10(value)), 0) / 6 AS evidence FROM bl JOIN lab ON bl.scene_id = lab.scene_id AND bl."row" = lab."row" AND bl.col BETWEEN c0 AND c1 JOIN sea ON bl.scene_id = sea.scene_id GROUP BY 1, 2),
      sc AS (SELECT *, n_pixels * 0.004 AS area_km2, n_pixels * 0.004 * evidence AS oil_score FROM ev WHERE n_pixels * 0.004 >= 0.02)
      SELECT scene_id, label, n_pixels, {_r('evidence area_km2 oil_score')}, oil_score >= 0.4 * max(oil_score) OVER (PARTITION BY scene_id) AS kept FROM sc""",
    "slick_axes": f"""WITH {BLOBS_SQL}, p AS (SELECT scene_id, 32.0::DOUBLE + (col + 0.5) * 0.0009::DOUBLE AS lon, 31.8::DOUBLE - ("row" + 0.5) * 0.0009::DOUBLE AS lat FROM bl WHERE mask AND col < "row"),
      c AS (SELECT scene_id, avg(lon) AS lo, avg(lat) AS la FROM p GROUP BY 1), l AS (SELECT p.scene_id, lo, la, radians(lon - lo) * cos(radians(la)) * 6371.0088 AS x, radians(lat - la) * 6371.0088 AS y FROM p JOIN c ON p.scene_id = c.scene_id),
      m AS (SELECT scene_id, lo, la, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, count(*) AS n FROM l GROUP BY 1, 2, 3),
      e AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS e1, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS e2 FROM m)
      SELECT scene_id, n AS n_pixels, round(lo, 5) AS center_lon, round(la, 5) AS center_lat, round(4 * sqrt(e1), 5) AS major_km, round(4 * sqrt(e2), 5) AS minor_km,
        round((degrees(atan2(e1 - yy, xy)) + 360) % 180, 5) AS orientation_deg FROM e""",
    "seg_metrics": f"WITH {PIXELS_SQL}, c AS (SELECT scene_id, count(*) FILTER (WHERE pred AND gt) AS tp, count(*) FILTER (WHERE pred AND NOT gt) AS fp, count(*) FILTER (WHERE NOT pred AND gt) AS fn FROM px GROUP BY 1) SELECT scene_id, round(2.0 * tp / (2 * tp + fp + fn + 1e-9), 6) AS dice, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall FROM c",
    "label_metrics": "WITH c AS (SELECT count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality <> 1) AS fp, count(*) FILTER (WHERE toxic <> 0 AND quality = 1) AS fn FROM labels) SELECT 1 AS scene_id, round(2.0 * tp / (2 * tp + fp + fn + 1e-9), 6) AS dice, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall FROM c",
    "false_alarm_objects": f"""WITH RECURSIVE {_cc(BLOBS_SQL, True)}, o AS (SELECT lab.scene_id, label, bool_or(gt AND (bl."row" + col) % 29 = 0) AS hit FROM bl JOIN lab ON bl.scene_id = lab.scene_id AND bl."row" = lab."row" AND bl.col BETWEEN c0 AND c1 GROUP BY 1, 2)
      SELECT scene_id, count(*) FILTER (WHERE NOT hit) AS false_alarm_objects FROM o GROUP BY 1""",
    "mask_agreement": f"WITH {PIXELS_SQL} SELECT scene_id, count(*) FILTER (WHERE pred AND gt) AS n_both, count(*) FILTER (WHERE pred OR gt) AS n_either, round(count(*) FILTER (WHERE pred AND gt) / greatest(count(*) FILTER (WHERE pred OR gt), 1), 6) AS iou FROM px GROUP BY 1",
    "mask_set_operations": f"WITH {PIXELS_SQL} SELECT scene_id, count(*) FILTER (WHERE pred AND gt) AS n, 'and' AS op FROM px GROUP BY 1 UNION ALL SELECT scene_id, count(*) FILTER (WHERE pred OR gt), 'or' FROM px GROUP BY 1 UNION ALL SELECT scene_id, count(*) FILTER (WHERE pred AND NOT gt), 'minus' FROM px GROUP BY 1",
    "detector_benchmark": "WITH b AS (SELECT source, lang AS detector, avg(n_chars) / 10000 AS dice, min(n_chars) AS low FROM documents GROUP BY 1, 2) SELECT detector, round(avg(dice), 6) AS dice, round(avg(low), 6) AS low, count(*) AS scenes FROM b GROUP BY 1",
    "detector_select": """WITH b AS (SELECT source AS scene, lang = 'en' AS net, avg(n_chars) / 10000 AS dice FROM documents GROUP BY ALL),
      p AS (SELECT scene, max(dice) FILTER (coalesce(net, FALSE)) AS n, max(dice) FILTER (NOT coalesce(net, FALSE)) AS o FROM b GROUP BY 1)
      SELECT scene, CASE WHEN o - n > 0.02 THEN 'otsu' ELSE 'deeplab' END AS detector,
        CASE WHEN n IS NULL THEN 'not_benchmarked' WHEN o IS NULL THEN 'otsu_not_benchmarked' WHEN abs(n - o) > 0.02 THEN 'better' ELSE 'within_margin' END AS reason FROM p""",
    "image_mask_pairs": """WITH p AS (SELECT page_id AS ord, '/data/' || CASE WHEN page_id % 3 = 0 THEN 'masks' WHEN page_id % 5 = 0 THEN 'Test' ELSE 'img' END || '/s' || (page_id % 40) || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.tif' END AS path FROM pages),
      k AS (SELECT *, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS stem, path LIKE '%mask%' AS is_mask FROM p), m AS (SELECT stem, arg_max(path, ord) AS mask_path FROM k WHERE is_mask GROUP BY 1)
      SELECT k.stem, k.path AS image_path, m.mask_path, k.path LIKE '%Test%' AS preferred FROM k JOIN m ON k.stem = m.stem WHERE NOT is_mask""",
    "acquisition_times": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1714557600.0 WHEN event_id % 3 < 2 THEN floor(epoch_us(ts) / 1000000) END AS es, CASE WHEN event_id % 7 = 0 THEN 'user_supplied' WHEN event_id % 3 = 0 THEN 'raster_tag:sensing_time' WHEN event_id % 3 = 1 THEN 'raster_tag:tifftag_datetime' END AS time_source FROM events",
    "scene_units": "SELECT * FROM (VALUES (0, 'uint8'), (1, 'linear'), (2, 'db'), (3, 'linear')) t(scene_id, units)",
    "case_summary": "SELECT 'case_' || s_suppkey AS case_id, CASE WHEN s_suppkey % 4 = 0 THEN 'NO_OIL_DETECTED' ELSE 'OK' END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal / 1000, 6) END AS area_km2, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS n_candidates FROM supplier",
}

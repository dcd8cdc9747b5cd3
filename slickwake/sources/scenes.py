"""Scenes: rendered ones, pairs of images and masks, and what is read from a product's tags and values.

Reading GeoTIFF needs a raster library that isn't a dependency; ``pixel_table`` takes arrays from whatever reads them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.operators.quantiles import exact_percentiles
from slickwake.functions.geo import KM_PER_DEG, local_km, pixel_to_lonlat, utc_time
from slickwake.functions.stats import decibel
from slickwake.sources.scratch import stored

# fixed values: tags that may hold an acquisition time, in order of preference
TIME_TAGS = ("ACQUISITION_START_TIME", "ACQUISITION_TIME", "SENSING_TIME", "SENSING_START", "PRODUCT_START_TIME", "TIFFTAG_DATETIME", "start_time", "acquisition_time", "datetime")
# fixed values: members of a product's JSON document that may hold its time, in order of preference
SIDECAR_KEYS = ("acquisition_time", "acquisition_start", "sensing_time", "datetime")
# fixed values: words in a path that mark a mask
MASK_WORDS = ("mask", "label", "/gt", "annot", "ground")
# fixed values: the four demonstration cases (case, date, centre latitude, centre longitude, km2); the pass is assumed at 03:52
DEMO_CASES = (
    ("case_A_2019-04-05", "2019-04-05", 31.295, 32.283, 4.7),
    ("case_B_2019-04-06", "2019-04-06", 31.372, 32.246, 4.4),
    ("case_C_2019-04-11", "2019-04-11", 31.315, 32.390, 2.2),
    ("case_D_2019-05-18", "2019-05-18", 31.347, 32.325, 2.0),
)


def case_specs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DEMO_CASES), "case_id string, date string, lat double, lon double, area_km2 double")
    return rows.withColumn("acquired", F.expr("CAST(concat(date, ' 03:52:00') AS TIMESTAMP_NTZ)"))


def pair_by_stem(files: DataFrame) -> DataFrame:
    """``stem, image_path, mask_path, preferred`` from ``path, ord``; of masks with one stem the last in order counts."""
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^.]+$", 1)
    is_mask = F.lower("path").rlike("|".join(MASK_WORDS))
    f = files.withColumn("stem", stem).withColumn("_m", is_mask)
    masks = f.where("_m").groupBy("stem").agg(F.max_by("path", "ord").alias("mask_path"))
    preferred = F.lower("path").rlike("test|val")
    return f.where("NOT _m").join(masks, "stem").select("stem", F.col("path").alias("image_path"), "mask_path", preferred.alias("preferred"))


def labelled_pairs(spark: SparkSession, root: str, limit: int = 30) -> DataFrame:
    """Pairs below a folder; of test and validation folders if there are any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").where(F.lower("path").rlike(r"\.(png|jpe?g|tiff?)$"))
    pairs = pair_by_stem(files.withColumn("ord", F.col("path")))
    some = pairs.agg(F.max("preferred").alias("_any"))
    return pairs.crossJoin(F.broadcast(some)).where("preferred OR NOT _any").drop("_any").orderBy("image_path").limit(limit)  # one row


def acquisition_time(override: str, tags: str, sidecar: str | None = None) -> tuple[Column, Column]:
    """(time, where it comes from): an override, else the first tag by preference that parses, else the time that the product's
    sidecar has (``sidecar``: a struct of ``time`` and ``name``), else nulls.  Never invented."""
    low = F.transform_keys(F.col(tags), lambda k, v: F.lower(k))
    # 2019:04:05 03:52:00 is how cameras write dates
    plain = lambda v: F.regexp_replace(v, r"^(\d{4}):(\d\d):", "$1-$2-")
    parsed = lambda v: utc_time(plain(v))
    tag = lambda t: F.element_at(low, t.lower())
    found = F.coalesce(*(F.when(parsed(tag(t)).isNotNull(), F.struct(parsed(tag(t)).alias("t"), F.lit(f"raster_tag:{t.lower()}").alias("s"))) for t in TIME_TAGS))
    given = F.when(F.col(override).isNotNull(), F.struct(parsed(F.col(override)).alias("t"), F.lit("user_supplied").alias("s")))
    beside = [F.when(F.col(f"{sidecar}.time").isNotNull(), F.struct(parsed(F.col(f"{sidecar}.time")).alias("t"), F.concat(F.lit("sidecar:"), F.col(f"{sidecar}.name")).alias("s")))] if sidecar else []
    both = F.coalesce(given, found, *beside)
    return both["t"], both["s"]


def sidecar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``folder, name, tags`` of the JSON documents below a folder: an object's members as text."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(*_folder_and_name("path"), F.from_json("value", "map<string,string>").alias("tags"))


def _folder_and_name(path: str) -> tuple[Column, Column]:
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_extract(plain, r"^(.*?)[^/\\]*$", 1).alias("folder"), F.regexp_extract(plain, r"([^/\\]+)$", 1).alias("name")


def with_sidecar(products: DataFrame, documents: DataFrame, path: str = "path") -> DataFrame:
    """``products`` with ``sidecar``, the time that a document beside a product has, and the document's name.

    The document of ``x.tif`` is ``x.tif.json``, else ``x.json``, else ``x_metadata.json``, in its folder; one that has
    none of the known members isn't taken.
    """
    folder, name = _folder_and_name(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    forms = F.array(*(F.struct(F.lit(k).alias("form"), F.concat(x, F.lit(end)).alias("document")) for k, (x, end) in enumerate(((name, ".json"), (stem, ".json"), (stem, "_metadata.json")))))
    wanted = products.select(F.col(path).alias("_product"), folder.alias("_folder"), F.explode(forms).alias("_f")).distinct()
    time = F.coalesce(*(F.element_at("tags", k) for k in SIDECAR_KEYS))
    known = documents.select(F.col("folder").alias("_folder"), F.col("name").alias("_name"), time.alias("_time")).where("_time IS NOT NULL")
    hit = wanted.join(known, (wanted["_folder"] == known["_folder"]) & (F.col("_f.document") == F.col("_name")))
    best = hit.groupBy("_product").agg(F.min_by(F.struct(F.col("_time").alias("time"), F.col("_name").alias("name")), "_f.form").alias("sidecar"))
    return products.join(best, F.col(path) == F.col("_product"), "left").drop("_product")


def infer_units(px: DataFrame) -> DataFrame:
    """``scene_id, units`` of ``scene_id, dtype, value``: 8-bit by type, linear if small and not negative, dB if negative."""
    p99 = exact_percentiles(px, ["scene_id"], F.col("value"), (0.99,)).select("scene_id", F.col("p")[0].alias("p99"))
    s = px.groupBy("scene_id").agg(F.first("dtype").alias("dtype"), F.min("value").alias("lo"), F.max("value").alias("hi")).join(p99, "scene_id", "left")
    units = F.when(F.col("dtype") == "uint8", "uint8").when((F.col("p99") <= 5) & (F.col("lo") >= 0), "linear").when((F.col("hi") <= 10) & (F.col("lo") < 0), "db").otherwise("linear")
    return s.select("scene_id", units.alias("units"))


def real_scenes(px: DataFrame, products: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes, pixels) of products that can be traced back from: ``scene_id, path, acquired, time_source, units``, and
    ``scene_id, row, col, value`` in decibels.

    ``px``: ``scene_id, row, col, value`` as read; ``products``: ``scene_id, path, crs, nodata, dtype, given_time, given_units, tags``;
    ``documents``: those beside the products (``sidecar_documents``).  Values equal to ``nodata`` are missing.  Units are those
    given, else inferred from type and range.  A product without a reference system lies nowhere, and one without a time
    can't be traced: both are errors that name the products, since neither is ever invented.
    """
    beside = with_sidecar(products, documents) if documents is not None else products.withColumn("sidecar", F.lit(None).cast("struct<time:string,name:string>"))
    time, source = acquisition_time("given_time", "tags", "sidecar")
    told = stored(beside.select("scene_id", "path", "crs", F.col("nodata").cast("double").alias("nodata"), "dtype", "given_units", time.alias("acquired"), source.alias("time_source")), "products")
    for missing, why in (("crs", "no reference system"), ("acquired", "no acquisition time: give one, in its tags or in a document beside it")):
        if some := told.where(F.col(missing).isNull()).select("path").limit(5).collect():
            raise ValueError(f"{', '.join(str(r['path']) for r in some)}: {why}")
    value = F.col("value").cast("double")
    known = px.join(told.select("scene_id", "dtype", "nodata"), "scene_id").withColumn("value", F.when(~F.isnan(value) & ~value.eqNullSafe(F.col("nodata")), value)).drop("nodata")
    units = told.join(infer_units(known), "scene_id", "left").withColumn("units", F.coalesce("given_units", "units"))
    scenes = stored(units.select("scene_id", "path", "acquired", "time_source", "units"), "scenes")
    pixels = known.join(scenes.select("scene_id", "units"), "scene_id").select("scene_id", "row", "col", decibel("value", F.col("units")).alias("value"))
    return scenes, pixels


def pixel_table(spark: SparkSession, scenes: Iterable[tuple[str, np.ndarray]]) -> DataFrame:
    """Arrays to ``scene_id, row, col, value``; NaN to null."""
    out = None
    for name, a in scenes:
        r, c = np.indices(a.shape)
        import pandas as pd

        part = spark.createDataFrame(pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": a.ravel().astype(float)}))
        part = part.select(F.lit(name).alias("scene_id"), "row", "col", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
        out = part if out is None else out.union(part)
    return out


def demo_scene(spark: SparkSession, scene_id: str, lat0: float, lon0: float, area_km2: float, size: int = 512, bearing_deg: float = 60.0, seed: int = 0,
               pixel_deg: float = 0.0009, oil_db: float = -7.5, lookalike: bool = True, lookalike_db: float = -3.0) -> DataFrame:
    """A rendered scene in decibels with its truth: ``scene_id, row, col, value, gt``.

    Sea with a gradient across the range and speckle from pixel hashes (a sum of uniform numbers), a wavy ellipse of oil
    along a bearing, and a wide faint patch that looks like oil.  Every pixel is made where it lies; nothing is sent.
    """
    west, north = lon0 - size * pixel_deg / 2, lat0 + size * pixel_deg / 2
    px = spark.range(size * size).select((F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    lon, lat = pixel_to_lonlat("row", "col", west, north, pixel_deg)
    x, y = local_km(lon, lat, lon0, lat0)
    th = float(np.deg2rad(bearing_deg))
    b = float(np.sqrt(area_km2 / (2 * np.pi)))
    along, across = x * np.sin(th) + y * np.cos(th), x * np.cos(th) - y * np.sin(th)
    across = across - 0.35 * b * F.sin(2 * np.pi * along / (6 * b))
    gt = F.pow(along / (2 * b), 2) + F.pow(across / b, 2) <= 1
    side = size * pixel_deg * KM_PER_DEG
    patch = F.exp(-F.pow(F.pow((x + 0.3 * side) / (3.6 * b), 2) + F.pow((y + 0.22 * side) / (2.4 * b), 2), 1.5)) if lookalike else F.lit(0.0)
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(scene_id), "row", "col", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    noise = (unit(1) + unit(2) + unit(3) - 1.5) * 4.0
    sea = 1.2 - 2.4 * F.col("col") / (size - 1) - 17
    value = sea + noise + F.when(gt, oil_db).otherwise(0.0) + lookalike_db * patch
    return px.select(F.lit(scene_id).alias("scene_id"), "row", "col", value.alias("value"), gt.alias("gt"))

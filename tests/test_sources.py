"""Files as they come: headers that differ, documents beside products, fields for other engines, summaries that are written again."""

import json

import pytest
from pyspark.sql import functions as F

from slickwake.operators.drift import uniform_fields
from slickwake.operators.field import ForcingCoverageError, GridField
from slickwake.sources import csv_files, currents, reports, scenes, sinks

HEAD = "date,time_utc,latitude,longitude,water_u_mps,water_v_mps"


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines))
    return str(folder)


def test_currents_are_read_by_each_files_own_header(spark, tmp_path):
    folder = write(tmp_path, Day_1=[HEAD, "2019-04-05,00:00:00,31,32,0.1,0.2"], Day_2=["date,time_utc,longitude,latitude,water_v_mps,water_u_mps,depth", "2019-04-05,06:00:00,32,31,0.2,0.1,0"], Day_3=[])
    rows = [tuple(r) for r in currents.read_current_csv(spark, folder).orderBy("t").collect()]
    assert [r[1:] for r in rows] == [(31.0, 32.0, 0.1, 0.2)] * 2 and rows[1][0] - rows[0][0] == 21600
    write(tmp_path, Day_4=["date,time_utc,latitude,longitude,water_u_bottom,water_v_bottom", "2019-04-05,12:00:00,31,32,9,9"])
    with pytest.raises(ForcingCoverageError, match="Day_4"):
        currents.read_current_csv(spark, folder)


def test_a_file_without_a_needed_column_is_named(spark, tmp_path):
    folder = write(tmp_path, Day_1=[HEAD, "2019-04-05,00:00:00,31,32,0.1,0.2"], Day_2=["date,latitude,longitude,water_u_mps,water_v_mps", "2019-04-05,31,32,0.1,0.2"])
    with pytest.raises(KeyError, match="Day_2.*time_utc"):
        currents.read_current_csv(spark, folder)


def test_reports_with_synonyms_that_differ_by_file(spark, tmp_path):
    folder = write(
        tmp_path,
        a=["MMSI,BaseDateTime,LAT,LON,SOG", "1,2024-01-01 00:00:00,31,32,5"],
        b=["lon,lat,userid,# timestamp,course", "33,30,2,2024-01-01T01:00:00Z,90"],
        c=['﻿MMSI,BaseDateTime,LAT,LON,"Vessel,Name",SOG', '3,2024-01-01 02:00:00,29,34,"a, b",7'],
    )
    got = {r["mmsi"]: (r["lat"], r["lon"], r["sog"], r["cog"]) for r in reports.read_reports(spark, folder).collect()}
    assert got == {1: (31.0, 32.0, 5.0, None), 2: (30.0, 33.0, None, 90.0), 3: (29.0, 34.0, 7.0, None)}
    write(tmp_path, d=["id,when", "1,2"])
    with pytest.raises(KeyError, match="no column"):
        reports.read_reports(spark, folder)


def test_order_is_by_file_and_place_however_splits_are_packed(spark, tmp_path):
    """The larger file sorts last by name, but Spark packs it first."""
    line = lambda i, la: f"7,2024-01-01 00:{i // 60:02d}:{i % 60:02d},{la},32"
    write(tmp_path, a=["MMSI,time,LAT,LON", *(line(i, 10) for i in range(5))], z=["MMSI,time,LAT,LON", *(line(i % 5, 50 + i / 1000) for i in range(3000))])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = reports.read_reports(spark, str(tmp_path)).orderBy("ord").select("lat").collect()
            assert [r["lat"] for r in rows] == [10.0] * 5 + [50 + i / 1000 for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert csv_files.first_lines(spark, str(tmp_path)).count() == 2


def test_kinds_of_current(spark, tmp_path):
    table = spark.createDataFrame([(0.0, 31.0, 392.0, 0.1, 0.2)], "t double, lat double, lon double, u double, v double")
    path = str(tmp_path / "c.parquet")
    table.write.parquet(path)
    with pytest.warns(UserWarning, match="surface"):
        assert currents.read_current(spark, path).first()["lon"] == 32.0
    with pytest.raises(ValueError, match="nc"):
        currents.read_current(spark, "x/y.nc", verified_surface=True)
    table.withColumnRenamed("u", "u_bottom").write.parquet(str(tmp_path / "b.parquet"))
    with pytest.raises(ForcingCoverageError):
        currents.read_current(spark, str(tmp_path / "b.parquet"), verified_surface=True)


def test_fields_for_other_engines(spark, tmp_path):
    field = spark.range(27).selectExpr("CAST(3600 * (id % 3) AS DOUBLE) AS t", "30D + (id div 3) % 3 AS lat", "31D + id div 9 AS lon", "CAST(id % 3 AS DOUBLE) AS u", "0.5D AS v")
    wind, _ = uniform_fields((5.0, 270.0), (0.1, 90.0))
    paths = currents.export_forcing(spark, (wind, GridField.of(field)), (31.5, 30.5, 32.0, 31.0), 1800.0, 7200.0, str(tmp_path), "c", grid_deg=0.25)
    got = spark.read.parquet(paths["current_field"])
    assert sorted(r["t"] for r in got.select("t").distinct().collect()) == [0.0, 3600.0, 7200.0]
    assert got.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()[:] == (30.25, 31.25, 31.25, 32.25)
    assert got.where("abs(u - t / 3600) > 1e-9 OR abs(v - 0.5) > 1e-9").count() == 0
    assert spark.read.parquet(paths["wind_field"]).where("abs(u - 5) > 1e-6").count() == 0
    with pytest.raises(ForcingCoverageError):
        currents.export_forcing(spark, (wind, GridField.of(field)), (31.5, 30.5, 32.0, 31.0), 1800.0, 9000.0, str(tmp_path), "c")


def test_times_from_documents_beside_products(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    docs = {
        "a.tif.json": {"sensing_time": "2019-04-05T03:52:00Z", "deep": {"x": 1}}, "a.json": {"acquisition_time": "2020-01-01 00:00:00"}, "b.json": {"note": "no time"},
        "b_metadata.json": {"acquisition_start": "2019-05-18T05:52:00+02:00", "datetime": "2000-01-01"}, "c.json": {"datetime": "2018-01-01 00:00:00"}, "sub/d.json": {"datetime": "2017-01-01 00:00:00"},
    }
    for name, d in docs.items():
        (tmp_path / name).write_text(json.dumps(d))
    rows = [(f"{tmp_path}/{n}.tif", None, {}) for n in "abde"] + [(f"{tmp_path}/c.tif", None, {"SENSING_TIME": "2019:04:06 03:52:00"}), (f"file:{tmp_path}/sub/d.tif", None, {}), (f"{tmp_path}/x/a.tif", "2021-01-01 00:00:00", {})]
    products = spark.createDataFrame(rows, "path string, given string, tags map<string,string>")
    t, s = scenes.acquisition_time("given", "tags", "sidecar")
    got = {r["path"].removeprefix("file:").removeprefix(str(tmp_path)): (str(r["t"]), r["s"]) for r in scenes.with_sidecar(products, scenes.sidecar_documents(spark, str(tmp_path))).select("path", t.alias("t"), s.alias("s")).collect()}
    assert got == {
        "/a.tif": ("2019-04-05 03:52:00", "sidecar:a.tif.json"), "/b.tif": ("2019-05-18 03:52:00", "sidecar:b_metadata.json"), "/c.tif": ("2019-04-06 03:52:00", "raster_tag:sensing_time"),
        "/d.tif": ("None", None), "/e.tif": ("None", None), "/sub/d.tif": ("2017-01-01 00:00:00", "sidecar:d.json"), "/x/a.tif": ("2021-01-01 00:00:00", "user_supplied"),
    }


def test_pairs_below_a_folder(spark, tmp_path):
    for name in ("images/a.png", "masks/a.png", "test/images/b.jpg", "test/labels/b.jpg", "images/lone.png", "masks/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    inside = tmp_path.name.replace("test", "")  # pytest's own folder names hold the word
    got = [(r["stem"], r["image_path"].rpartition("/")[2]) for r in scenes.labelled_pairs(spark, str(tmp_path)).collect()]
    assert inside and ("b", "b.jpg") in got and len(got) <= 2


def test_a_summary_written_again_replaces_its_own_case(spark, tmp_path):
    one = lambda case, n: spark.createDataFrame([(case, n)], "case_id string, n long")
    for case, n, run in (("a", 1, "r"), ("b", 2, "r"), ("a", 3, "r"), ("a", 4, "s")):
        sinks.write_summary(one(case, n), str(tmp_path), run)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "summary")).select("run_id", "case_id", "n").collect()) == [("r", "a", 3), ("r", "b", 2), ("s", "a", 4)]


def test_scenes_that_can_be_traced(spark, tmp_path):
    (tmp_path / "b_metadata.json").write_text(json.dumps({"sensing_time": "2019-04-05T03:52:00Z"}))
    kind = "scene_id string, path string, crs string, nodata double, dtype string, given_time string, given_units string, tags map<string,string>"
    rows = [("a", f"{tmp_path}/a.tif", "EPSG:4326", -99.0, "float32", None, None, {"ACQUISITION_TIME": "2019:04:06 03:52:00"}), ("b", f"{tmp_path}/b.tif", "EPSG:4326", None, "float32", None, None, {}), ("c", f"{tmp_path}/c.tif", "EPSG:32636", 0.0, "uint8", "2020-01-01 00:00:00", "db", {})]
    px = spark.createDataFrame([("a", 0, 0, 0.01), ("a", 0, 1, -99.0), ("a", 1, 0, 1.0), ("b", 0, 0, -20.0), ("b", 0, 1, float("nan")), ("b", 1, 1, 3.0), ("c", 0, 0, 0.0), ("c", 0, 1, 200.0)], "scene_id string, row int, col int, value double")
    documents = scenes.sidecar_documents(spark, str(tmp_path))
    found, pixels = scenes.real_scenes(px, spark.createDataFrame(rows, kind), documents)
    assert {r["scene_id"]: (str(r["acquired"]), r["time_source"], r["units"]) for r in found.collect()} == {
        "a": ("2019-04-06 03:52:00", "raster_tag:acquisition_time", "linear"), "b": ("2019-04-05 03:52:00", "sidecar:b_metadata.json", "db"), "c": ("2020-01-01 00:00:00", "user_supplied", "db"),
    }
    got = {(r["scene_id"], r["row"], r["col"]): r["value"] for r in pixels.collect()}
    assert got["a", 0, 0] == pytest.approx(-20.0) and got["a", 1, 0] == pytest.approx(0.0) and got["a", 0, 1] is None and got["b", 0, 0] == -20.0 and got["b", 0, 1] is None and got["c", 0, 0] is None and got["c", 0, 1] == 200.0
    with pytest.raises(ValueError, match="b.tif: no acquisition time"):
        scenes.real_scenes(px, spark.createDataFrame(rows, kind))
    with pytest.raises(ValueError, match="a.tif: no reference system"):
        scenes.real_scenes(px, spark.createDataFrame(rows, kind).withColumn("crs", F.when(F.col("scene_id") != "a", F.col("crs"))), documents)

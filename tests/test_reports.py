import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from slickwake.functions.geo import epoch_s, haversine_km
from slickwake.operators import ais, anomaly, attribution
from slickwake.plans.reports_queries import rounded
from slickwake.sources import reports

T0 = dt.datetime(2019, 4, 5)


def frame(spark, rows):
    return spark.createDataFrame([(m, T0 + dt.timedelta(minutes=t), la, lo, s, c, "n", "cargo", i) for i, (m, t, la, lo, s, c) in enumerate(rows)], "mmsi long, ts timestamp_ntz, lat double, lon double, sog double, cog double, vessel_name string, vessel_type string, ord long")


def test_cleaning(spark):
    df = frame(spark, [(1, 0, 31.0, 32.0, 50.0, -10.0), (1, 0, 31.5, 32.0, 1.0, 1.0), (1, 6, 0.0, 0.0, 1.0, 1.0), (1, 12, 91.0, 32.0, 1.0, 1.0), (1, 18, 31.01, 32.0, None, 725.0), (1, 24, 41.0, 32.0, 1.0, 1.0), (1, 30, 31.02, 32.0, 1.0, 1.0), (1, 600, 31.03, 32.0, 1.0, 1.0)])
    got = [(r["lat"], r["sog"], r["cog"]) for r in ais.clean(df).orderBy("ts").collect()]
    # the report that returns from a teleport is judged against it and goes too
    assert got == [(31.0, 40.0, 350.0), (31.01, None, 5.0), (31.03, 1.0, 1.0)]


def test_gap_of_exactly_the_limit_stays(spark):
    rows = [(1, 0, 31.0, 32.0, 1.0, 1.0), (1, 60, 31.0, 32.0, 1.0, 1.0)]
    seg = ais.segments(ais.clean(frame(spark, rows)))
    assert [r["segment_id"] for r in seg.orderBy("ts").collect()] == [0, 0]
    seg = ais.segments(ais.clean(frame(spark, [*rows, (1, 120.02, 31.0, 32.0, 1.0, 1.0)])))
    assert [r["segment_id"] for r in seg.orderBy("ts").collect()] == [0, 0, 1]


def test_interpolation_limit_and_circular_mean(spark):
    # bins of ten minutes: 0.6 degrees in 59 minutes are 37 knots, below the limit of 50
    rows = [(1, 0, 31.0, 32.0, 5.0, 350.0), (1, 1, 31.0, 32.0, 5.0, 10.0), (1, 60, 31.6, 32.0, 5.0, 90.0), (1, 61, 31.6, 32.0, 5.0, 90.0)]
    out = ais.fill_gaps(ais.resample(ais.segments(ais.clean(frame(spark, rows)), longest_gap_min=600.0), every_min=10), every_min=10, fewest_bins=3).orderBy("es").collect()
    assert [round(r["lat"], 6) for r in out] == [31.0, 31.1, 31.2, 31.3, 31.6]  # three bins, then nothing, then the next report
    assert min(out[0]["cog"], 360 - out[0]["cog"]) < 1e-9


def test_missing_speed(spark):
    rows = [(1, 6 * i, 31.0 + i / 100, 32.0, None, 5.0) for i in range(20)]
    strict = ais.regular(ais.segments(ais.clean(frame(spark, rows))), fewest_bins=7)
    loose = ais.regular(ais.segments(ais.clean(frame(spark, rows))), fewest_bins=7, speedless=True)
    assert strict.count() == 0 and loose.count() == 20


def test_position_on_and_between_reports(spark):
    t = frame(spark, [(1, 0, 31.0, 32.0, 5.0, 0.0), (1, 60, 31.6, 32.6, 5.0, 0.0), (1, 120, 32.2, 33.2, 5.0, 0.0), (2, 0, 1.0, 1.0, 1.0, 1.0)])
    end = (T0 + dt.timedelta(minutes=150) - dt.datetime(1970, 1, 1)).total_seconds()
    got = {r["k"]: (round(r["lat"], 9), r["gap_min"]) for r in attribution.positions_on_grid(t, end, 1800.0, 8).collect()}
    assert got == {1: (32.2, 60.0), 2: (31.9, 60.0), 3: (31.6, 60.0), 4: (31.3, 60.0), 5: (31.0, 60.0)}
    times = spark.createDataFrame([(1, end - 1800.0 * k) for k in range(9)] + [(2, end - 9000.0)], "mmsi long, q double")
    free = {round((end - r["q"]) / 1800): (round(r["lat"], 9), r["gap_min"]) for r in attribution.positions_at(t, times).where("mmsi = 1").collect()}
    assert free == got


def test_position_on_the_last_report_after_other_times(spark):
    """Times between two reports don't change the interval that ends at the last one."""
    t = frame(spark, [(1, 0, 31.0, 32.0, 5.0, 0.0), (1, 60, 31.6, 32.6, 5.0, 0.0), (1, 120, 32.2, 33.2, 5.0, 0.0)])
    q = lambda m: (T0 + dt.timedelta(minutes=m) - dt.datetime(1970, 1, 1)).total_seconds()
    both = attribution.positions_at(t, spark.createDataFrame([(1, q(90)), (1, q(105)), (1, q(120))], "mmsi long, q double"))
    alone = attribution.positions_at(t, spark.createDataFrame([(1, q(120))], "mmsi long, q double"))
    assert both.where(F.col("q") == q(120)).collect() == alone.collect()
    assert alone.first()["gap_min"] == 60.0 and round(alone.first()["sigma_km"], 3) == 2.515


def test_times_do_not_depend_on_the_session_zone(spark):
    from slickwake.functions.geo import utc_time

    rows = [("2019-03-31 02:30:00",), ("2019-03-31T02:30:00Z",), ("2019-03-31T04:30:00+02:00",), ("oops",), (None,), ("2019-03-31",)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = [r["t"] for r in spark.createDataFrame(rows, "s string").select(utc_time("s").alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2019, 3, 31, 2, 30)] * 3 + [None, None, dt.datetime(2019, 3, 31)]


def test_sequences_exclude_their_bin(spark):
    rows = [(1, 6 * i, 31.0 + 0.001 * i * i, 32.0, 5.0, 0.0) for i in range(12)]
    feat = ais.regular(ais.segments(ais.clean(frame(spark, rows))), fewest_bins=7)
    s = anomaly.sequences(feat, 4).orderBy("es").collect()
    assert [r["t"] for r in s] == list(range(4, 11)) and all(len(r["x"]) == 4 for r in s)
    assert s[0]["y2"] == pytest.approx(0.002 * 111_320, rel=1e-6)


def test_csv_with_other_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,# Timestamp,Latitude,Longitude,SOG\n1,2019-04-05 00:00:00,31,32,5\n2,oops,31,32,5\nx,2019-04-05 00:00:00,31,32,5\n3,2019-04-05 01:00:00,31.5,32.5,\n")
    df = reports.read_reports(spark, str(tmp_path / "a.csv"), bbox=(31.0, 30.0, 33.0, 32.0), t_range=("2019-04-05 00:00:00", "2019-04-05 01:00:00"))
    assert [(r["mmsi"], r["sog"], r["cog"], r["vessel_name"], r["vessel_type"]) for r in df.orderBy("mmsi").collect()] == [(1, 5.0, None, "1", "unknown"), (3, None, None, "3", "unknown")]
    with pytest.raises(ValueError, match="no reports"):
        reports.read_reports(spark, str(tmp_path / "a.csv"), bbox=(0.0, 0.0, 1.0, 1.0))
    with pytest.raises(KeyError):
        reports.resolve_columns(["MMSI", "LAT", "LON"])


def _two_opposite(spark):
    """Two opposite courses in the second bin, of which SQL's mean is what its sines leave."""
    rows = [(1, 0, 31.0, 32.0, 5.0, 10.0), (1, 10, 31.0, 32.01, 5.0, 117.0), (1, 11, 31.0, 32.01, 5.0, 297.0), (1, 20, 31.0, 32.02, 5.0, 20.0), (1, 30, 31.0, 32.03, 5.0, 30.0)]
    return ais.resample(ais.segments(ais.clean(frame(spark, rows))), every_min=10)


def test_mean_of_opposite_courses_is_that_of_sql(spark):
    got = [r["cog"] for r in _two_opposite(spark).orderBy("bin_no").collect()]
    mean = "avg(sin(radians(c))), avg(cos(radians(c)))"
    want = duckdb.sql(f"SELECT (degrees(atan2({mean})) % 360 + 360) % 360 FROM (VALUES (117.0::DOUBLE), (297.0::DOUBLE)) t(c)").fetchall()[0][0]
    assert got == pytest.approx([10.0, want, 20.0, 30.0], abs=1e-9)


def test_queries_round_as_their_sql(spark):
    # the product with a power of ten falls on a half that the shortest decimal form is not on, or the other way round
    values = [32.4996727565, 31.8422181625 + 4e-15, 1.0000000005, 2.0000000015, 31.0000000025, -31.0000000025, 0.0, -0.25e-9, 1.7e9 + 0.5, 1e300]
    values += [31 + (2 * i + 1) * 5e-10 for i in range(500)]
    got = {r["i"]: r["x"] for r in rounded(spark.createDataFrame(list(enumerate(values)), "i long, x double"), 9).collect()}
    want = duckdb.sql(f"SELECT i, round(x, 9) FROM (SELECT unnest(range({len(values)})) AS i, unnest({values!r}::DOUBLE[]) AS x)").fetchall()
    assert got == dict(want)


def test_features_of_opposite_courses(spark):
    """Course features are those of SQL's mean, not of the opposite of any noise."""
    df = ais.features(ais.fill_gaps(_two_opposite(spark), every_min=10, fewest_bins=3)).orderBy("es")
    mean = "atan2(avg(sin(radians(c))), avg(cos(radians(c))))"
    want = duckdb.sql(f"SELECT sin({mean}), cos({mean}) FROM (VALUES (117.0::DOUBLE), (297.0::DOUBLE)) t(c)").fetchall()[0]
    assert [(r["cog_sin"], r["cog_cos"]) for r in df.collect()][1] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("courses", [(57.0, 177.0, 297.0), (297.0, 57.0, 177.0), (303.0, 63.0, 183.0), (317.0, 77.0, 197.0), (117.0, 297.0, 59.0, 239.0)])
def test_mean_of_courses_that_cancel_is_that_of_sql(spark, courses):
    """Three courses at 120 degrees and two opposite pairs: SQL's mean is what its sines leave, summed in order of time."""
    rows = [(1, 0, 31.0, 32.0, 5.0, 10.0), *((1, 10 + i, 31.0, 32.01, 5.0, c) for i, c in enumerate(courses)), (1, 20, 31.0, 32.02, 5.0, 20.0)]
    df = frame(spark, rows).repartition(3, "cog")
    got = [r["cog"] for r in ais.resample(ais.segments(ais.clean(df)), every_min=10).orderBy("bin_no").collect()]
    mean = "avg(sin(radians(c))), avg(cos(radians(c)))"
    want = duckdb.sql(f"SELECT (degrees(atan2({mean})) % 360 + 360) % 360 FROM (SELECT unnest({list(courses)!r}::DOUBLE[]) AS c)").fetchall()[0][0]
    assert got == pytest.approx([10.0, want, 20.0], abs=1e-9)


def test_positions_of_equal_times_follow_ingest(spark):
    """Reports of one time are taken in the order of ingest, whatever order they come in: the last one before a time, the first one after."""
    rows = [(m, t, 31.0 + i / 100 + t / 1000, 32.0, 5.0, 0.0) for m in (1, 2) for t in (0, 60) for i in range(8)]
    end = (T0 - dt.datetime(1970, 1, 1)).total_seconds() + 3600.0
    for order in ("ord", "-ord"):
        df = frame(spark, rows).repartition(1).sortWithinPartitions(F.expr(order))
        got = attribution.positions_on_grid(df, end, 1200.0, 1).orderBy("mmsi").collect()
        assert [r["lat"] for r in got] == pytest.approx([(31.07 + 2 * 31.06) / 3] * 2, abs=1e-9)

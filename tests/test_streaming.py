import datetime as dt

import pytest


from slickwake.streaming import reports, silence

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        data = [(m, T0 + dt.timedelta(minutes=t), 31.0, 32.0, 5.0, c) for m, t, c in rows]
        spark.createDataFrame(data, "mmsi long, event_time timestamp, lat double, lon double, sog double, cog double").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema("mmsi long, event_time timestamp, lat double, lon double, sog double, cog double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


BATCHES = [[(1, 0, 350.0), (1, 3, 10.0), (2, 1, 90.0)], [(2, 8, 90.0), (2, 100, 90.0)], [(2, 400, 0.0)], [(2, 800, 0.0)]]


def test_bins(spark, tmp_path):
    got = {(r["mmsi"], r["w"]["start"]): r for r in run(spark, reports.binned(stream(spark, tmp_path, BATCHES)), "bins", tmp_path)}
    first = got[1, T0]
    assert first["n"] == 2 and min(first["cog"], 360 - first["cog"]) < 1e-6


def test_sessions(spark, tmp_path):
    got = sorted((r["mmsi"], r["n_fixes"]) for r in run(spark, reports.gap_sessions(stream(spark, tmp_path, BATCHES)), "sess", tmp_path))
    assert (1, 2) in got and (2, 2) in got


def test_dark_alerts(spark, tmp_path):
    got = run(spark, reports.dark_alerts(stream(spark, tmp_path, BATCHES)), "dark", tmp_path)
    assert 1 in {r["mmsi"] for r in got}


def silences(spark, source, sink, stops):
    """Alerts of files that come in one after another; the query is stopped and started again where ``stops`` says."""
    schema = "mmsi long, event_time timestamp, lat double, lon double, sog double, cog double"
    got = []

    def keep(df, _):
        got.extend(tuple(r) for r in df.collect())

    for batches in stops:
        for i, rows in batches:
            data = [(m, T0 + dt.timedelta(minutes=t), 31.0 + t / 1000, 32.0, 5.0, 0.0) for m, t in rows]
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(source / f"{i:02d}"))
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        q = silence.silence_alerts(read, (60.0, 180.0), 2000.0, "10 minutes").writeStream.foreachBatch(keep).option("checkpointLocation", str(sink)).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    ms = int(T0.timestamp() * 1000)
    return sorted((m, kind, level, (since - ms) // 60_000, (at - ms) // 60_000, round(lat, 3)) for m, kind, level, since, at, lat, _ in got)


SILENT_BATCHES = [(0, [(1, 0), (2, 0)]), (1, [(2, 50), (3, 45)]), (2, [(2, 100), (3, 20)]), (3, [(2, 150), (1, 140)]), (4, [(2, 210), (1, 150), (3, 200)]), (5, [(2, 230), (1, 400)]), (6, [(2, 5000)]), (7, [(1, 5010), (2, 5050)]), (8, [(2, 5100)])]


def plain_silences(reports, end):
    """Levels reached before the next report, or before the watermark at the end."""
    out = []
    for m in {m for m, _ in reports}:
        times = sorted({t for v, t in reports if v == m})
        for a, b in zip(times, [*times[1:], None]):
            levels = [level for level in (60, 180) if (b if b is not None else end) - a >= level]
            out += [(m, "SILENT", float(level), a, a + level, round(31 + a / 1000, 3)) for level in levels]
            if b is not None and levels and b - a < 2000:
                out.append((m, "HEARD", float(levels[-1]), a, b, round(31 + b / 1000, 3)))
    return sorted(out)


def test_silences_are_told_once_across_restarts(spark, tmp_path):
    got = silences(spark, tmp_path / "a", tmp_path / "ck_a", [SILENT_BATCHES[:3], SILENT_BATCHES[3:5], SILENT_BATCHES[5:]])
    reports = [r for _, rows in SILENT_BATCHES for r in rows if r != (3, 20)]  # behind the vessel's last report
    assert got == plain_silences(reports, 5100 - 11)
    assert len(set(got)) == len(got) and {k for _, k, *_ in got} == {"SILENT", "HEARD"}


def test_silences_do_not_depend_on_batches(spark, tmp_path):
    one = [(0, [r for _, rows in SILENT_BATCHES[:6] for r in rows if r != (3, 20)])]
    got = silences(spark, tmp_path / "b", tmp_path / "ck_b", [one])
    assert got == plain_silences(one[0][1], 400 - 11)


def test_vessels_are_not_forgotten_too_early(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS mmsi", "timestamp AS event_time", "0D AS lat", "0D AS lon")
    with pytest.raises(ValueError):
        silence.silence_alerts(stream, (60.0, 180.0), 100.0)

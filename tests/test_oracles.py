"""Every query with a DuckDB counterpart gives its rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from slickwake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)

    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            try:
                df[c] = df[c].astype(float).round(5).fillna(-9e9) + 0.0
            except (TypeError, ValueError):
                df[c] = df[c].astype(str).replace({"None": "", "nan": ""})
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    x, y = plain(a), plain(b)
    for c in x.columns:
        if x[c].dtype == float:
            assert ((x[c] - y[c]).abs() <= 1e-4 * (1 + y[c].abs())).all(), c
        else:
            assert (x[c].astype(str) == y[c].astype(str)).all(), c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    same(registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def _opposite_courses(folder) -> duckdb.DuckDBPyConnection:
    """Vessels near the slick, each with one bin of two opposite courses (117 and 297 degrees), as tables in ``folder``."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute("""create table events as select * exclude (n), (n * 7) % 200 / 10.0::DOUBLE AS value, '{}' AS props from (
      select u * 144000 + b * 720 + (case when b = 9 then 261 else b * b * 7 + 1 end) AS event_id, TIMESTAMP '2024-01-16 00:10:00' + INTERVAL (6 * b) HOUR AS ts, u AS user_id, 'view' AS event_type, u * 16 + b * b AS n
      from (select unnest([7, 8, 207, 208, 407, 408]::BIGINT[]) AS u), (select unnest(range(17)) AS b)
      union all select u * 144000 + 9 * 720 + 441, TIMESTAMP '2024-01-18 06:40:00', u, 'view', u from (select unnest([7, 8, 207, 208, 407, 408]::BIGINT[]) AS u))""")
    c.execute(f"create table part as select * from '{SF}/part.parquet'")
    for t in ("events", "part"):
        c.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["vessel_anomaly", "fuse_scored"])
def test_scores_after_opposite_courses(spark, tmp_path, name):
    """The mean of two opposite courses is the error of their sines; scores follow it through the jumps of course."""
    c = _opposite_courses(tmp_path)
    want = c.execute(registry.oracle_sql()[name]).df()
    assert len(want)
    same(registry.queries()[name](spark, str(tmp_path)).toPandas(), want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["vessel_anomaly", "fuse_scored"])
def test_scores_after_three_courses_that_cancel(spark, tmp_path, name):
    """The same with 57, 177 and 297 degrees in the bin; with one thread, SQL sums them in order of time."""
    c = _opposite_courses(tmp_path)
    c.execute("update events set event_id = event_id - event_id % 720 + (case event_id % 720 when 261 then 201 else 321 end) where event_id % 720 in (261, 441)")
    c.execute("insert into events select event_id + 120, ts + INTERVAL 10 MINUTE, user_id, event_type, value, props from events where event_id % 720 = 321")
    c.execute(f"copy (select * from events order by event_id) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute("set threads = 1")
    want = c.execute(registry.oracle_sql()[name]).df()
    assert len(want)
    same(registry.queries()[name](spark, str(tmp_path)).toPandas(), want)

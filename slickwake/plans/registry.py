"""All queries of the library itself (without the optional training-data subpackage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slickwake.plans import chain_queries, drift_queries, raster_queries, reports_queries, traffic_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reports_queries.QUERIES, **drift_queries.QUERIES, **raster_queries.QUERIES, **traffic_queries.QUERIES, **chain_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reports_queries.SQL, **drift_queries.SQL, **raster_queries.SQL, **traffic_queries.SQL, **chain_queries.SQL}

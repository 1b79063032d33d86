"""All core queries by name, each a callable of (spark, directory of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import feature_queries, system_queries, timeseries, timeseries_sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    names = ("p1_found", "p1_totals", "p2_found", "p2_flags", "p3_found", "p3_capacity", "p4_found", "p4_instants", "p5_found", "p5_editions", "p5_diverted", "p6_found", "p6_filled")
    return {n: getattr(timeseries, n) for n in names} | feature_queries.queries() | system_queries.queries()


def oracle_sql() -> dict[str, str]:
    return feature_queries.oracle_sql() | system_queries.oracle_sql() | timeseries_sql.ORACLES

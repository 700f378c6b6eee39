"""Registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans import driver_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(driver_queries.SQL)

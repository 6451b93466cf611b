"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geometry, space


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return geometry.QUERIES | space.QUERIES


def oracle_sql() -> dict[str, str]:
    return geometry.SQL | space.SQL

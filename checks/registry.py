"""Where every query meets its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.relations_sql import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, query: Query, sql: str | None = None) -> None:
    QUERIES[key] = query
    if sql is not None:
        ORACLES[key] = oracle(sql)

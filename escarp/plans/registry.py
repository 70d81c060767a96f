"""Registry of queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle metres in SQL."""
    return (
        f"2 * 6371008.8 * asin(least(1.0, sqrt("
        f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def mix_sql(seed: str, *parts: str) -> str:
    """The pseudo-random integer of `functions.stats.mix` in SQL."""
    h = f"(CAST({seed} AS BIGINT) % 2147483647)"
    for part in parts:
        h = f"(({h} * 48271 + CAST({part} AS BIGINT) % 2147483647 + 11) % 2147483647)"
    square = f"({h} * {h} % 2147483647)"
    return f"({square} * {square} % 2147483647 * {h} % 2147483647)"

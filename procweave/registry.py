"""The queries of the reference's own operators and their DuckDB twins, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query under its key, with SQL that gives the same rows where SQL can."""

    def register(function):
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return register

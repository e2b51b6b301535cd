"""Registry of the named queries: key -> (Spark plan, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a plan under ``key`` with the SQL that must give the same rows."""

    def wrap(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return wrap


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["act_search"](spark, sf_dir)

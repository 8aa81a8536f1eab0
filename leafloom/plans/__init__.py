"""Queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle, queries


def catalog_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(queries, n) for n in queries.NAMES}


def oracles() -> dict[str, str]:
    return dict(oracle.ORACLE)

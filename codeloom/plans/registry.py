"""The registered queries of the graph engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import queries as own

entry = own.entry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.ORACLES)

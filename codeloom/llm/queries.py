"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from codeloom.shipping import ship

_MODULES = ["near_dedup", "line_dedup", "decontaminate", "pii", "packing", "quality", "toxicity", "url_filter", "warc", "ann"]


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every opN_<name> of this subpackage."""
    out = {}
    for name in _MODULES:
        module = import_module(f"codeloom.llm.{name}")
        out.update({k: _shipped(v) for k, v in vars(module).items() if k.startswith("op") and k[2].isdigit()})
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        module = import_module(f"codeloom.llm.{name}")
        if hasattr(module, "SQL"):
            out.update({k: module.SQL for k in vars(module) if k.startswith("op") and k[2].isdigit()})
    return out

"""All queries of the core, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with a `QUERIES` dict and a `SQL` dict.
MODULES: list[str] = [
    "docloom.plans.corpus",
    "docloom.plans.operations",
    "docloom.operators.changes",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_tag_summary"](spark, sf_dir)

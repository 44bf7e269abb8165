"""The queries of the subpackage, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "docloom.llm.tokens",
    "docloom.llm.history",
    "docloom.llm.main_body",
    "docloom.llm.near",
    "docloom.llm.packing",
    "docloom.llm.quality",
    "docloom.llm.repetition",
    "docloom.llm.scans",
    "docloom.llm.source_lines",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).SQL.items()}

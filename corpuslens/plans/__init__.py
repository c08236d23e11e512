"""Named queries with their SQL counterparts, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "search", "enrichment", "ingest", "pipeline", "text", "timestamps", "lookups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").SQL
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["p4_found"](spark, folder)

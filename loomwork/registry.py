"""All queries of the library: name -> Spark function, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("retrieval", "text", "catalog", "structure", "chunking", "streams", "geometry", "hierarchy", "files")


def _modules():
    return [importlib.import_module(f"loomwork.plans.{name}") for name in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r1_semantic_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}

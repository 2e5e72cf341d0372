"""All queries of the engine's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog, documents, governance, retrieval, usage  # noqa: F401  they register their queries
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["A6_search"](spark, sf_dir)

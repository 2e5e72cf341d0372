"""Registration of queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (tables) under ``name``; ``tables`` loads driver tables lazily by attribute."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    """Driver tables by name, and the model tables derived from them (``noctua.sources.driver``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def _input(self) -> str:
        return hashlib.sha256(self.sf_dir.encode()).hexdigest()[:16]

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table made of this input, stored once for the application."""
        from noctua.sources.tables import kept

        return kept(self.spark, f"{name}-{self._input}", make)

    def index(self, name: str, fields: tuple[str, ...], live: str = "true"):
        """The search index of the rows of a model table that are ``live``, built once for the application."""
        from noctua.operators.index import Index
        from noctua.sources.tables import kept_dir

        folder = f"{kept_dir(self.spark)}/index-{name}-{self._input}"
        return Index(self.spark, folder) if Index.there(self.spark, folder) else Index.build(getattr(self, name).where(live), folder, fields)

    def scratch(self, name: str) -> str:
        """A new folder beside the kept tables."""
        import uuid

        from noctua.sources.tables import kept_dir

        return f"{kept_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        from noctua.sources import driver

        made = getattr(driver, name, None)
        return made(self) if made else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

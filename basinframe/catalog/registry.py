"""Registry of runnable queries: each pairs a Spark query with the SQL it must match."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The supplied tables, read lazily; columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def wells(self) -> DataFrame:
        from basinframe.catalog.shapes import wells

        return wells(self)


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``; ``sql`` is the equivalent the result is checked against."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def fix(c: Column | str, digits: int = 6) -> Column:
    """Round by the same arithmetic as :func:`fix_sql`, so both engines agree."""
    x = F.col(c) if isinstance(c, str) else c
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def fix_sql(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 5e-1) / 1e{digits})"


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")

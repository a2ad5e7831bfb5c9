"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; sql is what DuckDB must return, row for row."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + F.lit(0.0)


from gridwake.plans import fields, geometry, joins, lookups, streams  # noqa: E402, F401

"""The registered queries by name, and their results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and decimals as DOUBLE, as the SQL gives them."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*(F.col(f"`{n}`").cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(n) for n, t in df.dtypes))


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add

"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check if it has one."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of additions does not show."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def r6(*columns: str) -> str:
    """The same rounding in SQL; ``a=b`` names column ``a`` from expression ``b``."""
    parts = []
    for column in columns:
        name, _, expression = column.partition("=")
        parts.append(f"round({expression or name}, 6) + 0.0 AS {name}")
    return ", ".join(parts)

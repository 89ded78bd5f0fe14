"""Skipping what an earlier output already holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from eventlens.operators.selection import pending_items
from eventlens.session import settle
from eventlens.sources.tables import finished_keys


def pending_filter(
    spark: SparkSession, output: str, keys: list[str], fmt: str = "parquet"
) -> Callable[[DataFrame], DataFrame]:
    """A filter for rows whose keys the output does not hold yet; all rows without an output."""
    try:
        done = finished_keys(spark, output, keys, fmt)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return lambda rows: rows
    stored = settle(done, "done")
    return lambda rows: pending_items(rows, stored, keys)

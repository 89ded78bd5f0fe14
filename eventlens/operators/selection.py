"""Row and column selection: first per key, pending items, all-null columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.session import broadcast_within


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in a given order.

    Spark limits each key to one row before the shuffle, so a key with many
    copies sends one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("keep_rank", rank).where(F.col("keep_rank") == 1).drop("keep_rank")


def pending_items(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys are not among the finished ones.

    Finished keys are broadcast when shown to fit, so that items, which may be
    many rows per key, are not moved.
    """
    return items.join(broadcast_within(done.select(*keys).distinct()), keys, "left_anti")


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a single value; one aggregation, one row to the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] == 0]


def drop_all_null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*all_null_columns(df, columns))

"""Stored layouts that later jobs read without moving or opening more than they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.pairs import settled_spans, ticks_in_span
from eventlens.session import Settled, settled
from eventlens.sources.sinks import replace_partitions

BAR_KEYS = ["instrument", "trade_date"]


def store_bucketed(bars: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Bars as a table in buckets by instrument and day, whose data lie at ``path``.

    Sums per instrument and day and joins with the days of events then find bars where
    they lie: estimates and event bars of any number of runs share one
    shuffle, that of the writing. Days are part of the key, so that an instrument with a third
    of all bars is in all buckets. ``path`` is a folder all executors reach.
    """
    writer = bars.repartition(buckets, *BAR_KEYS).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *BAR_KEYS).sortBy(*BAR_KEYS).saveAsTable(table)
    return bars.sparkSession.table(table)


def tick_venue(instrument: Column) -> Column:
    """Two letters a full code begins with."""
    return F.substring(instrument, 1, 2)


def store_ticks(ticks: DataFrame, path: str) -> None:
    """Ticks in folders by day and venue; those of the days and venues that come are replaced."""
    day, place = F.to_date("ts").alias("trade_date"), tick_venue(F.col("instrument")).alias("venue")
    keyed = ticks.where(F.col("ts").isNotNull() & F.col("instrument").isNotNull()).select("*", day, place)
    replace_partitions(keyed.repartition("trade_date", "venue"), path, ["trade_date", "venue"])


def stored_ticks_in_span(spark: SparkSession, path: str, spans: DataFrame | Settled) -> DataFrame:
    """``ticks_in_span`` of ticks stored by :func:`store_ticks`, opening only files that spans touch.

    The days and venues of all spans, at most one row per date and venue, are sent to the scan while the job
    runs. Folders are selected by day and by venue, so days in the gaps between spans and venues without a
    span are not opened.
    """
    spans = settled_spans(spans)
    ticks = spark.read.parquet(path)
    if spans.values["first"] is None:
        return ticks.where(F.lit(False)).drop("trade_date", "venue")
    first, last = (F.lit(spans.values[v]).cast("date") for v in ("first", "last"))
    days = spans.frame.select(
        tick_venue(F.col("rival_fc")).alias("venue"), F.explode(F.sequence("first_day", "last_day")).alias("trade_date"),
    ).distinct()
    wanted = settled(days, "wanted-days")
    # the bounds say nothing new of the rows, but tell the planner that the list narrows the scan
    listed = wanted.frame.where(F.col("trade_date").between(first, last))
    touched = ticks.join(F.broadcast(listed) if wanted.rows <= 1 << 20 else listed, ["trade_date", "venue"], "left_semi")
    return ticks_in_span(touched.drop("trade_date", "venue"), spans)

"""The last close of every instrument and day, kept beside the ticks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from eventlens.functions.nulls import number
from eventlens.operators.bars import tick_order
from eventlens.operators.pairs import settled_spans
from eventlens.session import BROADCAST_BYTES, Settled, settle
from eventlens.sources.sinks import replace_partitions

CLOSES = "instrument string, close double, day date"


def daily_closes(ticks: DataFrame, tie_col: str | None = "tick_id") -> DataFrame:
    """``instrument, day, close``: the price of an instrument's last trade of a day, NULL where that trade has none.

    It is the price of the day's last bar, whatever the width of bars. Ticks are
    combined before the shuffle, so a day costs a task one row per instrument.
    """
    order = F.col("ts") if tie_col is None else tick_order(F.col("ts"), F.col(tie_col))
    known = ticks.where(F.col("instrument").isNotNull() & F.col("ts").isNotNull())
    return known.groupBy("instrument", F.to_date("ts").alias("day")).agg(F.max_by(number(F.col("price")), order).alias("close"))


def read_closes(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index, or None where there is none yet."""
    try:
        return spark.read.schema(CLOSES).parquet(path).select("instrument", "day", "close")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def last_indexed_day(spark: SparkSession, path: str) -> dt.date | None:
    """The newest day of the stored index, from the names of its folders; None without one."""
    stored = read_closes(spark, path)
    return None if stored is None else stored.agg(F.max("day")).first()[0]


def refresh_closes(ticks: DataFrame, path: str, since: dt.date | None = None, tie_col: str | None = "tick_id") -> DataFrame:
    """Bring the index at ``path`` up to date with ``ticks`` and return it.

    Days are partitions. Only ticks from ``since`` on are read, by default from the
    newest indexed day, which may have been stored before it was over; their days
    are replaced and all others left as they are, so a run that is repeated
    changes nothing. The first run reads everything; ticks that arrive later for earlier days
    need a ``since``.
    """
    spark = ticks.sparkSession
    first = since or last_indexed_day(spark, path)
    if first is not None:
        ticks = ticks.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    replace_partitions(daily_closes(ticks, tie_col), path, ["day"])
    found = read_closes(spark, path)
    # nothing was written where there are no ticks at all
    return settle(daily_closes(ticks, tie_col), "closes") if found is None else found


def closes_before(closes: DataFrame, spans: DataFrame | Settled) -> DataFrame:
    """``instrument, day, close`` per day of the index inside ``spans`` (see ``instrument_span``): the close of the last day traded before it.

    The day before the first of a span lies outside it, at any distance, and is found in
    the index, one row per instrument and day; ticks are not read. Later days of an
    instrument beyond the last span are left out. ``close`` is NULL on an instrument's first day of all.
    """
    spans = settled_spans(spans)
    if spans.values["last"] is None:
        return closes.where(F.lit(False)).select("instrument", "day", "close")
    bounds = spans.broadcastable(BROADCAST_BYTES).select(
        F.col("rival_fc").alias("instrument"), F.col("first_day").alias("span_first"), F.col("last_day").alias("span_last"),
    )
    known = closes.where(F.col("day") <= F.lit(spans.values["last"])).join(bounds, "instrument")
    previous = F.lag("close").over(Window.partitionBy("instrument").orderBy("day"))
    return known.select("instrument", "day", previous.alias("close"), "span_first", "span_last").where(
        F.col("day").between(F.col("span_first"), F.col("span_last"))
    ).select("instrument", "day", "close")

"""Readers for the study's input tables. Types are stated, never inferred."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import schemas
from eventlens.functions.nulls import nan_to_null
from eventlens.functions.times import parse_date, parse_hhmm
from eventlens.operators.calendar import trading_calendar
from eventlens.operators.selection import keep_first


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Table of a stated schema from parquet, ORC, JSON lines or CSV with a header."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        # columns are matched by header position; enforceSchema off checks the names
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.load(path)


# Headers of the event sheet and the name of each column here.
EVENT_HEADERS = {
    "INDEX2009": "ipo_id", "Stkcd": "ipo_stkcd", "日期": "roadshow_date", "开始时间": "start_time", "结束时间": "end_time",
}
# Headers of the media sheet; its other columns keep their names.
MEDIA_HEADERS = {"INDEX2009": "index2009", "采用视频平台": "platform"}


def read_sheet(spark: SparkSession, path: str, headers: dict[str, str], fmt: str = "csv") -> DataFrame:
    """A sheet saved as CSV with its own headers, or as parquet: all columns text, renamed.

    Headers are matched by name, blanks around them set aside; a missing one raises.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    named = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
    missing = [h for h in headers if h not in named]
    if missing:
        raise ValueError(f"the sheet has no column {missing}")
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(headers.get(h, h)) for h, c in named.items()])


def read_event_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The event sheet under the names of ``schemas.EVENT_INDEX``, for the two functions below."""
    return read_sheet(spark, path, EVENT_HEADERS, fmt).select(*schemas.EVENT_INDEX.names)


def event_index(raw: DataFrame) -> DataFrame:
    """``ipo_id, ipo_stkcd_raw, roadshow_date`` of rows whose date can be read."""
    return raw.select(
        "ipo_id",
        F.col("ipo_stkcd").alias("ipo_stkcd_raw"),
        parse_date(F.col("roadshow_date")).alias("roadshow_date"),
    ).where(F.col("roadshow_date").isNotNull())


def event_times(raw: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Start and end of each event as text and as minutes of the day, one row per id.

    Of several rows of an id the first is kept, by date and then by the times
    (a row without times comes last) unless another order is given.
    """
    dated = raw.select(
        "ipo_id",
        parse_date(F.col("roadshow_date")).alias("roadshow_date"),
        F.substring("start_time", 1, 5).alias("roadshow_start"),
        F.substring("end_time", 1, 5).alias("roadshow_end"),
    ).where(F.col("roadshow_date").isNotNull())
    first = keep_first(dated, ["ipo_id"], order or ["roadshow_date", *[F.asc_nulls_last(f"roadshow_{c}") for c in ("start", "end")]])
    return first.select(
        "*",
        parse_hhmm(F.col("roadshow_start")).alias("start_minute"),
        parse_hhmm(F.col("roadshow_end")).alias("end_minute"),
    )


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The three pair columns; other columns of the file are never read."""
    if fmt == "csv":
        return spark.read.option("header", True).csv(path).select(*schemas.PAIRS.names)
    return read_table(spark, path, schemas.PAIRS, fmt)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar from a JSON document with a ``workdays`` list of yyyymmdd texts."""
    raw = spark.read.schema(schemas.CALENDAR_FILE).option("multiLine", True).json(path)
    days = raw.select(F.explode("workdays").alias("day"))
    return trading_calendar(days.select(F.to_date("day", "yyyyMMdd").alias("trade_date")))


def in_span(ts: Column, first: dt.date, last: dt.date) -> Column:
    """Times from the start of the first day to the end of the last."""
    # dates, unlike Python datetimes, become literals without regard to a time zone
    after = last + dt.timedelta(days=1)
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(after).cast("timestamp_ntz"))


def scan_bars(
    bars: DataFrame,
    first: dt.date | None = None,
    last: dt.date | None = None,
    instruments: list[str] | None = None,
) -> DataFrame:
    """Bars or ticks of some instruments and a span of whole days.

    The bounds are literals, so they reach the file scan and prune partitions.
    """
    if instruments is not None:
        bars = bars.where(F.col("instrument").isin(*instruments))
    if first is not None and last is not None:
        bars = bars.where(in_span(F.col("ts"), first, last))
    return bars


def read_event_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored abnormal returns and volumes per event bar; NaN is read as NULL."""
    return nan_to_null(read_table(spark, path, schemas.EVENT_BARS, fmt))


def read_modality(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored feature table with whatever columns it has; NaN is read as NULL.

    A missing path raises, as an absent required modality should.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        known = {f.name: f.dataType for s in (schemas.VOCAL, schemas.VERBAL, schemas.VISUAL) for f in s.fields}
        return nan_to_null(raw.select(*[F.col(c).try_cast(known.get(c, T.StringType())).alias(c) for c in raw.columns]))
    return nan_to_null(spark.read.format(fmt).load(path))


def finished_keys(spark: SparkSession, path: str, keys: list[str], fmt: str = "parquet") -> DataFrame:
    """Distinct keys of an earlier output; only the key columns are read."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path).select(*keys).distinct()

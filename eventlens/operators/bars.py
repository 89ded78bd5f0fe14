"""Bars from ticks, returns from bars, and alignment with a market series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.functions.nulls import number
from eventlens.session import BROADCAST_BYTES, Settled, broadcast_within


def tick_order(ts: Column, tick_id: Column) -> Column:
    """One sortable number for (time, id): microseconds first, then the id.

    A decimal key lets the last-trade aggregate run in the hash operator; with
    a struct key Spark sorts every tick first, and spills when a task's ticks
    exceed its memory. Local times of the two were alike. The factor exceeds
    the span of 64-bit ids, so ids never reach the time. The interval keeps
    the session's time zone out of it.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = (ts - epoch).cast("interval second").cast("decimal(18,6)")
    micros = (seconds * F.expr("1000000BD")).cast("decimal(18,0)")
    return micros * F.expr("20000000000000000000BD") + tick_id.cast("decimal(19,0)")


def resample_bars(
    ticks: DataFrame, freq: str = "5 minutes", tie_col: str | None = "tick_id"
) -> DataFrame:
    """Last price and total size per instrument and bar, labelled by bar start.

    Expects ``instrument, ts, price, size`` and an integer ``tie_col`` that
    orders trades of the same time (None when times are unique, which took
    about a third of the time in a local test). Ticks are
    combined before the shuffle, so an instrument with most of the ticks costs
    no more than its number of bars. NaN is NULL: a last trade without price
    gives a bar without price.
    """
    order = F.col("ts") if tie_col is None else tick_order(F.col("ts"), F.col(tie_col))
    return (
        ticks.where(F.col("instrument").isNotNull() & F.col("ts").isNotNull())
        .groupBy("instrument", F.window("ts", freq).alias("bar"))
        .agg(
            F.max_by(number(F.col("price")), order).alias("price"),
            F.sum(number(F.col("size"))).alias("volume"),
        )
        .select("instrument", F.col("bar.start").alias("ts"), "price", "volume")
    )


def bar_returns(bars: DataFrame, chunk: str = "day", opens: DataFrame | None = None) -> DataFrame:
    """Simple return over the previous bar of the same instrument.

    Adds ``trade_date``, ``prev_price`` and ``return``; the return is NULL for
    the first bar and after a zero price. Instruments are cut into chunks of a
    ``day``, ``month`` or ``year`` so that none is ordered in one task; the
    bar before a chunk comes from the last price of the chunk before it. The
    bars are read twice, so they should be a stored table. A NaN price is NULL.

    ``opens`` has the close before a day, as ``instrument, day, close`` (see
    ``closes_before``), for bars that are a part of a history, which must then be in chunks of a day. These
    closes stand among the bars as the first of their day, so the bars are read
    once, shuffled once and joined with nothing.
    """
    bars = bars.withColumn("price", number(F.col("price")))
    day = F.to_date("ts")
    if opens is not None:
        if chunk != "day":
            raise ValueError("closes before days need chunks of a day")
        fronts = opens.select("instrument", F.col("day").alias("trade_date"), F.col("close").alias("price"), F.lit(True).alias("front"))
        rows = bars.withColumns({"trade_date": day, "front": F.lit(False)}).unionByName(fronts, allowMissingColumns=True)
        order = Window.partitionBy("instrument", "trade_date").orderBy(F.col("front").desc(), "ts")
        return _with_return(rows.withColumn("prev_price", F.lag("price").over(order)).where(~F.col("front")))
    part = day if chunk == "day" else F.trunc(day, chunk)
    keyed = bars.withColumn("chunk", part)
    closes = keyed.groupBy("instrument", "chunk").agg(F.max_by("price", "ts").alias("close"))
    opens = closes.select(
        "instrument",
        "chunk",
        F.lag("close").over(Window.partitionBy("instrument").orderBy("chunk")).alias("open_ref"),
    )
    order = Window.partitionBy("instrument", "chunk").orderBy("ts")
    previous = F.when(F.row_number().over(order) == 1, F.col("open_ref")).otherwise(
        F.lag("price").over(order)
    )
    return _with_return(keyed.join(opens, ["instrument", "chunk"]).withColumns({"prev_price": previous, "trade_date": day}))


def _with_return(bars: DataFrame) -> DataFrame:
    change = (F.try_divide(F.col("price"), F.col("prev_price")) - 1).alias("return")
    return bars.select("instrument", "ts", "trade_date", "price", "volume", "prev_price", change)


def align_market(
    bars: DataFrame, market: DataFrame | Settled, max_bytes: int = BROADCAST_BYTES, how: str = "left"
) -> DataFrame:
    """Attach the market return of the same bar as ``market_return``.

    The market has one row per bar time; NaN is NULL. It is broadcast when it is shown to
    fit and joined by shuffle on the bar time otherwise. A market that is stored
    with its number of rows is not stored again.
    """
    known = isinstance(market, Settled)
    series = (market.frame if known else market).select("ts", number(F.col("return")).alias("market_return"))
    series = Settled(series, market.rows, {}).broadcastable(max_bytes) if known else broadcast_within(series, max_bytes)
    return bars.join(series, "ts", how)


def align_series(
    series: dict[str, DataFrame], keys: list[str], value_col: str = "value"
) -> DataFrame:
    """Outer alignment of named series on their keys, one column per series.

    Series hold at most one row per key. They are stacked and combined in one
    aggregation, which needs one shuffle where chained outer joins need one each.
    """
    names = list(series)
    stacked = None
    for name, df in series.items():
        part = df.select(
            *keys, *[(F.col(value_col) if n == name else F.lit(None).cast("double")).alias(n) for n in names]
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])

"""Trading calendar, day offsets and the windows of an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class StudySpec:
    """Estimation windows and event window as inclusive trading-day offsets."""

    estimation: tuple[tuple[int, int], ...] = ((-120, -30), (-30, -5), (-5, -2))
    event: tuple[int, int] = (-1, 1)

    @property
    def numbers(self) -> range:
        return range(1, len(self.estimation) + 1)

    def offsets(self) -> dict[str, int]:
        """Boundary column name to day offset."""
        named = {}
        for k, (first, last) in enumerate(self.estimation, 1):
            named[f"est{k}_start"], named[f"est{k}_end"] = first, last
        named["event_start"], named["event_end"] = self.event
        return named


def trading_calendar(dates: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Distinct dates numbered from 1 in order: ``(trade_date, day_idx)``.

    The set of dates is combined in the tasks that read them; it has at most 366
    members per year of history whatever the size of the input.
    """
    days = dates.agg(F.array_sort(F.collect_set(F.col(date_col).cast("date"))).alias("days"))
    return days.select(F.posexplode("days").alias("place", "trade_date")).select(
        "trade_date", (F.col("place") + 1).alias("day_idx"),
    )


def shifted_days(calendar: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Calendar with one more date column per named offset, NULL off the ends."""
    order = Window.orderBy("day_idx")
    return calendar.select(
        "trade_date",
        "day_idx",
        *[F.lead("trade_date", n).over(order).alias(name) for name, n in offsets.items()],
    )


def nth_trading_day(
    df: DataFrame, calendar: DataFrame, offsets: dict[str, int], date_col: str = "event_date"
) -> DataFrame:
    """Add the date that lies ``n`` trading days from ``date_col`` per named offset.

    NULL when the date is not a trading day or the offset leaves the calendar.
    A calendar holds one row per date, so it is small enough to broadcast.
    """
    shifted = shifted_days(calendar, offsets).withColumnRenamed("trade_date", date_col)
    return df.join(F.broadcast(shifted), date_col, "left")


def event_windows(
    events: DataFrame, calendar: DataFrame, spec: StudySpec = StudySpec(), date_col: str = "event_date"
) -> DataFrame:
    """Window boundaries per event; events with any boundary missing are dropped."""
    offsets = spec.offsets()
    return nth_trading_day(events, calendar, offsets, date_col).dropna(subset=list(offsets))


def event_days(calendar: DataFrame, spec: StudySpec = StudySpec()) -> DataFrame:
    """Every trading day of the event window of each date: ``(event_date, trade_date)``."""
    first, last = spec.event
    names = {f"day{n}": n for n in range(first, last + 1)}
    shifted = shifted_days(calendar, names)
    return shifted.select(
        F.col("trade_date").alias("event_date"),
        F.explode(F.array(*names)).alias("trade_date"),
    ).where(F.col("trade_date").isNotNull())

"""Abnormal return and abnormal volume per bar of the event window."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.nulls import nan_to_null
from eventlens.operators.calendar import StudySpec, event_days
from eventlens.operators.estimation import estimates
from eventlens.session import Settled, fits, settled

VOLUME_METHODS = ("diff", "ratio")
# Results that one task makes and, where they are cut into windows, sorts: about 25 MB.
BARS_PER_TASK = 1 << 18


def abnormal_return_col(k: int) -> Column:
    """Return less the market model's expectation."""
    return F.col("return") - (F.col(f"alpha_est{k}") + F.col(f"beta_est{k}") * F.col("market_return"))


def abnormal_volume_col(k: int, method: str = "diff") -> Column:
    """Volume against its mean over the estimation window."""
    if method not in VOLUME_METHODS:
        raise ValueError(f"volume method must be one of {VOLUME_METHODS}, not {method!r}")
    volume, base = F.col("volume").cast("double"), F.col(f"vol_mean_est{k}")
    return volume - base if method == "diff" else F.try_divide(volume, base) - 1


def abnormal_bars(
    aligned: DataFrame,
    calendar: DataFrame,
    pair_windows: DataFrame,
    spec: StudySpec = StudySpec(),
    volume_method: str = "diff",
    min_obs: int = 2,
) -> DataFrame:
    """``ipo_id, rival_fc, event_date, timestamp, ar_est1.., av_est1..`` per event bar.

    ``pair_windows`` holds ``ipo_id, rival_fc, event_date`` of events that have
    all their windows. A series depends on instrument and event day only, so it
    is made once per such pair (:func:`event_series`); pairs then meet the series (:func:`bars_of_pairs`).
    """
    return bars_of_pairs(pair_windows, event_series(aligned, calendar, pair_windows, spec, volume_method, min_obs))


def event_series(
    aligned: DataFrame,
    calendar: DataFrame,
    pair_windows: DataFrame,
    spec: StudySpec = StudySpec(),
    volume_method: str = "diff",
    min_obs: int = 2,
) -> Settled:
    """``rival_fc, event_date, timestamp, ar_est1.., av_est1..``: one series per instrument and event day that pairs ask for.

    Bars are found by equality on instrument and day; no range join is needed. The calendar, one
    row per date, is broadcast. The frame is not stored; its rows are counted, and ``results`` is the
    number of rows that all pairs will have. Store it (``settled``) where more than one step reads it.
    """
    asked = settled(
        pair_windows.select(F.col("rival_fc").alias("instrument"), "event_date")
        .groupBy("instrument", "event_date").agg(F.count(F.lit(1)).alias("n_pairs")), "asked")
    coefficients = estimates(aligned, calendar, asked.frame, spec, min_obs)
    # the few days of events are picked out of all bars before these are shuffled
    found = asked.frame.join(F.broadcast(event_days(calendar, spec)), "event_date")
    first, last = spec.event
    days = Settled(found.select("instrument", "event_date", "trade_date", "n_pairs"), asked.rows * (last - first + 1), {}).broadcastable()
    met = aligned.select("instrument", "trade_date").join(days, ["instrument", "trade_date"])
    size = met.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_pairs").alias("results")).first()
    bars = nan_to_null(
        aligned.select("instrument", "trade_date", "ts", "return", "volume", "market_return")
    ).join(days, ["instrument", "trade_date"], "left_semi")
    series = coefficients.join(days, ["instrument", "event_date"]).join(bars, ["instrument", "trade_date"]).select(
        F.col("instrument").alias("rival_fc"),
        "event_date",
        F.col("ts").alias("timestamp"),
        *[abnormal_return_col(k).alias(f"ar_est{k}") for k in spec.numbers],
        *[abnormal_volume_col(k, volume_method).alias(f"av_est{k}") for k in spec.numbers],
    )
    return Settled(series, size["rows"], {"results": size["results"] or 0})


def bars_of_pairs(pair_windows: DataFrame, series: Settled) -> DataFrame:
    """The series of every pair, which is where rows multiply: ``ipo_id`` and the columns of ``series``.

    The number of results is known by then, and pairs are dealt by their keys into tasks of about
    BARS_PER_TASK results each. What later groups by these keys finds the results where they are.
    """
    pairs, bars = pair_windows.select("ipo_id", "rival_fc", "event_date"), series.frame
    if fits(bars, series.rows):
        tasks = max(1, -(-series.values["results"] // BARS_PER_TASK))
        pairs, bars = pairs.repartition(tasks, "ipo_id", "rival_fc", "event_date"), F.broadcast(bars)
    return pairs.join(bars, ["rival_fc", "event_date"]).select("ipo_id", *series.frame.columns)


def modelled_returns(
    aligned: DataFrame,
    calendar: DataFrame,
    requests: DataFrame,
    model: Callable[[pd.DataFrame, pd.DataFrame], pd.Series],
    spec: StudySpec = StudySpec(),
) -> DataFrame:
    """Abnormal returns under a user's own model, per ``(instrument, event_date)``.

    ``model(estimation, event)`` gets bars with ``ts, return, market_return``
    and gives the expected return of each event bar. It is called once per
    estimation window, on the bars of one instrument over the days of one
    event. Attach results to pairs by instrument and event date. This path
    reads every bar of every window; the market model of ``abnormal_bars``
    needs only daily sums.
    """
    lowest = min(first for first, _ in spec.estimation)
    highest = max(spec.event[1], *(last for _, last in spec.estimation))
    days = F.broadcast(calendar)
    asked = (
        requests.select("instrument", "event_date")
        .distinct()
        .join(days.select(F.col("trade_date").alias("event_date"), F.col("day_idx").alias("event_idx")), "event_date")
        .select(
            "instrument",
            "event_date",
            F.explode(F.sequence(F.lit(lowest), F.lit(highest))).alias("offset"),
            "event_idx",
        )
        .withColumn("day_idx", F.col("event_idx") + F.col("offset"))
        .join(days, "day_idx")
    )
    bars = asked.join(aligned, ["instrument", "trade_date"]).select(
        "instrument", "event_date", "offset", "ts", "return", "market_return"
    )
    names = [f"ar_est{k}" for k in spec.numbers]
    windows, event = spec.estimation, spec.event

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        inside = group[group["offset"].between(*event)]
        out = inside[["instrument", "event_date", "ts"]].copy()
        for name, window in zip(names, windows):
            out[name] = inside["return"] - model(group[group["offset"].between(*window)], inside)
        return out

    schema = "instrument string, event_date date, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names)
    return bars.groupBy("instrument", "event_date").applyInPandas(apply, schema)

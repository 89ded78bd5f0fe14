"""Event-rival pairs: dates, instrument codes, spans, groups and rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.codes import full_code
from eventlens.operators.calendar import StudySpec, event_days
from eventlens.operators.estimation import estimates
from eventlens.session import Settled, broadcast_within, settle, settled
from eventlens.sources.tables import scan_bars


def pair_events(pairs: DataFrame, events: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Distinct pairs with their event date, instrument code and windows.

    Pairs are the same when their full codes are, however a code is spelt;
    codes that are no number are left out. ``events`` has one row per ``ipo_id``; pairs without a dated event are
    dropped. With ``windows`` of these events (see ``event_windows``) the boundaries are added
    and pairs of events that lack them are dropped.
    """
    coded = (
        pairs.withColumn("rival_fc", full_code(F.col("rival_stkcd")))
        .dropna(subset=["rival_fc"])
        .groupBy("ipo_id", "rival_fc")
        .agg(F.min("ipo_stkcd").alias("ipo_stkcd"), F.min("rival_stkcd").alias("rival_stkcd"))
    )
    if windows is None:
        return coded.join(events.select("ipo_id", "event_date"), "ipo_id", "left").dropna(subset=["event_date"])
    # windows are of dated events and hold their dates
    return coded.join(windows, "ipo_id")


def instrument_span(pair_windows: DataFrame) -> DataFrame:
    """First and last day needed per instrument, with its number of events."""
    return pair_windows.groupBy("rival_fc").agg(
        F.min("est1_start").alias("first_day"),
        F.max("event_end").alias("last_day"),
        F.count(F.lit(1)).alias("n_events"),
    )


def global_span(windows: DataFrame) -> tuple:
    """First and last day needed over all events, as two dates on the driver."""
    row = windows.agg(F.min("est1_start").alias("a"), F.max("event_end").alias("b")).first()
    return row["a"], row["b"]


def events_nested(pair_windows: DataFrame, target: int = 1000) -> DataFrame:
    """Events of each instrument as arrays of structs in event-date order.

    An instrument with more than ``target`` events is spread over several
    rows by a hash of the event id, so no array grows with the data. ``part``
    runs from 0 to ``n_parts - 1``. The number of parts, a row per instrument, is
    broadcast when shown to fit, so the events meet only after they are split.
    """
    fields = ["event_date", "ipo_id", "est1_start", "event_end"]
    parts = pair_windows.groupBy("rival_fc").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(target)).cast("int").alias("n_parts")
    )
    bucket = F.conv(F.substring(F.md5("ipo_id"), 1, 8), 16, 10).cast("bigint")
    return (
        pair_windows.join(broadcast_within(parts), "rival_fc")
        .groupBy("rival_fc", "n_parts", F.pmod(bucket, F.col("n_parts")).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("events"))
    )


def settled_spans(spans: DataFrame | Settled) -> Settled:
    """``spans`` (see ``instrument_span``) stored, with their outer bounds."""
    return settled(spans, "spans", first=F.min("first_day"), last=F.max("last_day"))


def ticks_in_span(ticks: DataFrame, spans: DataFrame | Settled) -> DataFrame:
    """Ticks or bars of the instruments and days of ``spans`` (see ``instrument_span``).

    The outer bounds are literals that reach the scan, and nothing beyond them
    is read; each instrument's own span is a semi-join with one row per
    instrument. The close before a day, which its first return needs, comes from
    the index of closes (``closes_before``).
    """
    spans = settled_spans(spans)
    if spans.values["first"] is None:
        return ticks.where(F.lit(False))
    near = scan_bars(ticks, spans.values["first"], spans.values["last"])
    bounds = spans.broadcastable().select("rival_fc", F.col("first_day").alias("span_first"), F.col("last_day").alias("span_last"))
    inside = F.to_date("ts").between(F.col("span_first"), F.col("span_last"))
    return near.join(bounds, (F.col("instrument") == F.col("rival_fc")) & inside, "left_semi")


def pair_outcomes(
    pairs: DataFrame,
    events: DataFrame,
    windows: DataFrame,
    aligned: DataFrame,
    calendar: DataFrame,
    spec: StudySpec = StudySpec(),
    min_obs: int = 2,
) -> DataFrame:
    """What became of every pair: ``ipo_id, rival_stkcd, rival_fc, event_date, reason``.

    ``reason`` is NULL for a pair with a result, else one of ``bad code`` (the
    rival's code is no number), ``no event`` (no date is known for the id),
    ``no window`` (the day or an offset of it is not in the calendar), ``no data``
    (no bar in any of the pair's own windows), ``no event bars`` (none on the days
    of the event), ``no estimate`` (no estimation window gives a model or a
    volume; the bars then have only NULLs). Spellings of one code are one pair.
    """
    coded = (
        pairs.withColumn("rival_fc", full_code(F.col("rival_stkcd")))
        .withColumn("spelling", F.when(F.col("rival_fc").isNull(), F.col("rival_stkcd")))
        .groupBy("ipo_id", "rival_fc", "spelling").agg(F.min("rival_stkcd").alias("rival_stkcd"))
    )
    known = windows.select("ipo_id", F.lit(True).alias("has_window"))
    dated = coded.join(events.select("ipo_id", "event_date"), "ipo_id", "left").join(known, "ipo_id", "left")
    early = (
        F.when(F.col("rival_fc").isNull(), "bad code")
        .when(F.col("event_date").isNull(), "no event")
        .when(F.col("has_window").isNull(), "no window")
    )
    judged = settle(dated.withColumn("early", early), "judged")
    requests = judged.where("early IS NULL").select(F.col("rival_fc").alias("instrument"), "event_date").distinct()
    fitted = estimates(aligned, calendar, requests, spec, min_obs)
    days = requests.join(F.broadcast(event_days(calendar, spec)), "event_date")
    met = (
        days.join(aligned.select("instrument", "trade_date"), ["instrument", "trade_date"])
        .groupBy("instrument", "event_date").agg(F.count(F.lit(1)).alias("event_bars"))
    )
    none_of = lambda test: reduce(Column.__and__, [test(k) for k in spec.numbers])
    no_rows = none_of(lambda k: (F.col(f"n_est{k}") == 0) & (F.col(f"vol_n_est{k}") == 0))
    no_fit = none_of(lambda k: F.col(f"alpha_est{k}").isNull() & F.col(f"vol_mean_est{k}").isNull())
    late = (
        fitted.join(met, ["instrument", "event_date"], "left")
        .select(
            F.col("instrument").alias("rival_fc"), "event_date",
            F.when(F.col("event_bars").isNull() & no_rows, "no data")
            .when(F.col("event_bars").isNull(), "no event bars")
            .when(no_fit, "no estimate").alias("late"),
        )
    )
    return judged.join(late, ["rival_fc", "event_date"], "left").select(
        "ipo_id", "rival_stkcd", "rival_fc", "event_date", F.coalesce("early", "late").alias("reason"),
    )


def event_rejects(outcomes: DataFrame) -> DataFrame:
    """Pairs of :func:`pair_outcomes` that yield no result, with the reason."""
    return outcomes.where("reason IS NOT NULL")

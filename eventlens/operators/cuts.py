"""Event bars cut into windows around the event time, and summed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.functions.nulls import nan_to_null
from eventlens.functions.times import at_minute, is_minute
from eventlens.operators.abnormal import BARS_PER_TASK
from eventlens.session import Settled, broadcast_within, fits, settled

KEYS = ["ipo_id", "rival_fc", "event_date"]
# What a pair's windows depend on: a series, and how many of its bars are earlier than the event's times (-1 without a time).
CUT_KEYS = ["rival_fc", "event_date", "event_start_n", "event_end_n"]
# Pairs that get their sums in one task: about 6 MB of 84 numbers each.
PAIRS_PER_TASK = 1 << 13


@dataclass(frozen=True)
class CutSpec:
    """Day session, the excluded minute and the bar counts of the windows.

    Minutes are minutes of the day. The defaults are 09:25 to 15:00, with the
    09:25 opening auction excluded in the ``no925`` variant, and windows of 6
    and 12 five-minute bars.
    """

    day_open: int = 9 * 60 + 25
    day_close: int = 15 * 60
    excluded: int = 9 * 60 + 25
    spans: tuple[tuple[str, int], ...] = (("30min", 6), ("1hr", 12))
    estimations: tuple[int, ...] = (1, 2, 3)

    @property
    def windows(self) -> list[str]:
        return [
            "full_day",
            *[
                f"{place}_{label}"
                for place in ("before_start", "after_start", "after_end")
                for label, _ in self.spans
            ],
        ]


VARIANTS = ("with925", "no925")
METRICS = {"car": "ar", "cav": "av"}


def cut_columns(spec: CutSpec = CutSpec()) -> list[str]:
    """Names of the summed columns, ``{car,cav}_{window}_{variant}_est{n}``."""
    return [
        f"{metric}_{window}_{variant}_est{k}"
        for window in spec.windows
        for k in spec.estimations
        for variant in VARIANTS
        for metric in METRICS
    ]


def ranked_bars(
    df: DataFrame, keys: list[str], thresholds: list[str], ts_col: str = "timestamp"
) -> DataFrame:
    """Add the position of each bar in its group and, per threshold column,
    the number of bars strictly earlier (``{threshold}_n``).

    One ordering serves selections before and after any number of thresholds.
    """
    group = Window.partitionBy(*keys)
    earlier = [
        F.count(F.when(F.col(ts_col) < F.col(t), 1)).over(group).alias(f"{t}_n") for t in thresholds
    ]
    order = group.orderBy(ts_col, *_ties(df))
    return df.select("*", F.row_number().over(order).alias("bar_no"), *earlier)


def _ties(df: DataFrame) -> list[str]:
    """Value columns, which decide between bars of one time so that the choice is fixed."""
    return [c for c in df.columns if c.startswith(("ar_", "av_"))]


def is_before(threshold: str, n: int, ts_col: str = "timestamp") -> Column:
    """Among the last ``n`` bars strictly earlier than the threshold."""
    return (F.col(ts_col) < F.col(threshold)) & (F.col("bar_no") > F.col(f"{threshold}_n") - n)


def is_after(threshold: str, n: int, ts_col: str = "timestamp") -> Column:
    """Among the first ``n`` bars at or after the threshold."""
    return (F.col(ts_col) >= F.col(threshold)) & (F.col("bar_no") <= F.col(f"{threshold}_n") + n)


def bars_before(
    df: DataFrame, keys: list[str], threshold: str, n: int, ts_col: str = "timestamp"
) -> DataFrame:
    """Rows among the last ``n`` of their group strictly before a threshold column.

    A NULL threshold selects nothing. Bars are counted whether or not their
    values are NULL. Ranking keeps at most ``n`` rows per group on the map
    side.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(ts_col), *[F.desc(c) for c in _ties(df)])
    return (
        df.where(F.col(ts_col) < F.col(threshold))
        .withColumn("bar_rank", F.row_number().over(order))
        .where(F.col("bar_rank") <= n)
    )


def bars_after(
    df: DataFrame, keys: list[str], threshold: str, n: int, ts_col: str = "timestamp"
) -> DataFrame:
    """Rows among the first ``n`` of their group at or after a threshold column."""
    order = Window.partitionBy(*keys).orderBy(ts_col, *_ties(df))
    return (
        df.where(F.col(ts_col) >= F.col(threshold))
        .withColumn("bar_rank", F.row_number().over(order))
        .where(F.col("bar_rank") <= n)
    )


def attach_times(event_bars: DataFrame, times: DataFrame) -> DataFrame:
    """Add ``event_start`` and ``event_end`` from ``ipo_id, start_minute, end_minute``.

    An event missing from ``times`` keeps NULL times; of an id that occurs twice
    the earliest times count, so bars never multiply. Times are broadcast when
    shown to fit, so that bars are not gathered by event.
    """
    single = times.groupBy("ipo_id").agg(F.min(F.struct("start_minute", "end_minute")).alias("t"))
    small = broadcast_within(single.select("ipo_id", "t.start_minute", "t.end_minute"))
    with_times = event_bars.join(small, "ipo_id", "left")
    return with_times.select(
        *event_bars.columns,
        at_minute(F.col("event_date"), F.col("start_minute")).alias("event_start"),
        at_minute(F.col("event_date"), F.col("end_minute")).alias("event_end"),
    )


def window_cuts_wide(
    event_bars: DataFrame, times: DataFrame, spec: CutSpec = CutSpec()
) -> DataFrame:
    """CAR and CAV of every window, variant and estimation, one row per group.

    The bars of a window are chosen first; the excluded minute is then left
    out of the sum of the ``no925`` variant, on whatever day it falls. A sum
    over no value is NULL. Groups with a NULL key are dropped. Ordering and
    summing share one shuffle on the three keys; a group has the bars of one
    instrument on the few days of an event window, whatever the data size.
    """
    bars = attach_times(nan_to_null(event_bars).dropna(subset=KEYS), times)
    return _window_sums(ranked_bars(bars, KEYS, ["event_start", "event_end"]), KEYS, spec)


def distinct_cuts(
    pairs: DataFrame, series: Settled, times: DataFrame, spec: CutSpec = CutSpec()
) -> tuple[Settled, Settled]:
    """The windows of pairs before these multiply: pairs with CUT_KEYS, and one row of sums per CUT_KEYS.

    ``pairs`` are distinct; ``series`` is stored (``abnormal.event_series``). Two pairs of one series have
    equal windows when the same bars are earlier than their times, so each series is cut once per such
    position, of which it has few, however many pairs there are. ``cuts_of_pairs`` gives the sums to pairs.
    """
    bars, group = nan_to_null(series.frame).dropna(subset=KEYS[1:]), KEYS[1:]
    small = fits(bars, series.rows)
    hint = F.broadcast if small else (lambda df: df)
    stamps = bars.groupBy(*group).agg(F.collect_list("timestamp").alias("stamps"))
    timed = attach_times(pairs.select(*KEYS).dropna(), times).join(hint(stamps), group)

    def earlier(threshold: str) -> Column:
        count = F.size(F.filter("stamps", lambda ts: ts < F.col(threshold)))
        return F.when(F.col(threshold).isNotNull(), count).otherwise(-1).alias(f"{threshold}_n")

    thresholds = ["event_start", "event_end"]
    members = settled(timed.select(*KEYS, *map(earlier, thresholds), *thresholds, F.size("stamps").alias("n_bars")), "members")
    # any times of a position stand for all of them
    positions = settled(
        members.frame.groupBy(*CUT_KEYS).agg(*[F.min(c).alias(c) for c in (*thresholds, "n_bars")]), "positions",
        bars=F.sum("n_bars"))
    asked = positions.frame.drop("n_bars")
    if small:
        asked = asked.repartition(max(1, -(-(positions.values["bars"] or 0) // BARS_PER_TASK)), *CUT_KEYS)
    order = Window.partitionBy(*group).orderBy("timestamp", *_ties(bars))
    numbered = bars.select("*", F.row_number().over(order).alias("bar_no"))
    sums = _window_sums(asked.join(hint(numbered), group), CUT_KEYS, spec)
    return members, settled(sums, "cuts")


def cuts_of_pairs(members: Settled, sums: Settled) -> DataFrame:
    """One row of window sums per pair, from the two frames of :func:`distinct_cuts`.

    Pairs are dealt by event into tasks of about PAIRS_PER_TASK before they get their sums, so that
    rivals of an event are averaged where they are.
    """
    pairs, few = members.frame.select("ipo_id", *CUT_KEYS), sums.broadcastable()
    if fits(sums.frame, sums.rows):
        pairs = pairs.repartition(max(1, -(-members.rows // PAIRS_PER_TASK)), "ipo_id", "event_date")
    return pairs.join(few, CUT_KEYS).select(*KEYS, *[c for c in sums.frame.columns if c not in CUT_KEYS])


def _window_sums(ranked: DataFrame, keys: list[str], spec: CutSpec) -> DataFrame:
    """The conditional sums of ranked bars per group."""
    day, ts = F.col("event_date"), F.col("timestamp")
    member = {"full_day": ts.between(at_minute(day, spec.day_open), at_minute(day, spec.day_close))}
    for label, n in spec.spans:
        member[f"before_start_{label}"] = is_before("event_start", n)
        member[f"after_start_{label}"] = is_after("event_start", n)
        member[f"after_end_{label}"] = is_after("event_end", n)
    values = [f"{v}_est{k}" for k in spec.estimations for v in METRICS.values()]
    # bars of a group that are in the same windows are added up first: a group
    # has few such classes, and only they meet the many conditional sums
    flags = [member[w] for w in spec.windows] + [is_minute(ts, spec.excluded)]
    mask = reduce(add, [F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags)])
    classes = (
        ranked.select(*keys, mask.alias("mask"), *values)
        .groupBy(*keys, "mask")
        .agg(*[F.sum(v).alias(v) for v in values])
    )

    def has(i: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(1 << i)) != 0

    excluded = has(len(spec.windows))
    sums = []
    for i, window in enumerate(spec.windows):
        for k in spec.estimations:
            for variant in VARIANTS:
                counted = has(i) if variant == "with925" else has(i) & ~excluded
                for metric, value in METRICS.items():
                    name = f"{metric}_{window}_{variant}_est{k}"
                    sums.append(F.sum(F.when(counted, F.col(f"{value}_est{k}"))).alias(name))
    return classes.groupBy(*keys).agg(*sums)


def window_cuts(wide: DataFrame, spec: CutSpec = CutSpec()) -> DataFrame:
    """Long form of the wide table: one row per window, variant and estimation."""
    rows = [
        F.struct(
            F.lit(window).alias("window"),
            F.lit(variant).alias("variant"),
            F.lit(k).alias("est"),
            F.col(f"car_{window}_{variant}_est{k}").alias("car"),
            F.col(f"cav_{window}_{variant}_est{k}").alias("cav"),
        )
        for window in spec.windows
        for variant in VARIANTS
        for k in spec.estimations
    ]
    return wide.select(*KEYS, F.explode(F.array(*rows)).alias("row")).select(*KEYS, "row.*")

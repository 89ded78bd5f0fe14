"""The event study from ticks to yearly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.functions.codes import full_code
from eventlens.operators.abnormal import bars_of_pairs, event_series
from eventlens.operators.bars import align_market, bar_returns, resample_bars
from eventlens.operators.calendar import StudySpec, event_windows
from eventlens.operators.closes import closes_before, daily_closes, refresh_closes
from eventlens.operators.cuts import KEYS, CutSpec, cuts_of_pairs, distinct_cuts, window_cuts_wide
from eventlens.operators.pairs import (
    event_rejects,
    instrument_span,
    pair_events,
    pair_outcomes,
    settled_spans,
    ticks_in_span,
)
from eventlens.operators.rollup import rival_mean, year_stats
from eventlens.operators.selection import keep_first, pending_items
from eventlens.plans.resume import pending_filter
from eventlens.session import Settled, scratch_scope, settle, settled
from eventlens.sources.sinks import replace_partitions, sink_append, sink_overwrite
from eventlens.sources.tables import finished_keys, read_event_bars

MARKET = "SH000300"
FREQ = "5 minutes"


def returns_from_ticks(ticks: DataFrame, freq: str = FREQ, chunk: str = "day") -> DataFrame:
    """Bars with returns of every instrument. Ticks are read once; bars are stored."""
    return bar_returns(settle(resample_bars(ticks, freq), "bars"), chunk)


def first_events(index: DataFrame) -> DataFrame:
    """One date per event id, the earliest, as ``ipo_id, event_date``."""
    dated = index.select("ipo_id", F.col("roadshow_date").alias("event_date"))
    return keep_first(dated, ["ipo_id"], ["event_date"])


def study_series(
    ticks: DataFrame,
    market: DataFrame,
    calendar: DataFrame,
    pairs: DataFrame,
    events: DataFrame,
    spec: StudySpec = StudySpec(),
    freq: str = FREQ,
    volume_method: str = "diff",
    min_obs: int = 2,
    closes: DataFrame | None = None,
) -> tuple[DataFrame, Settled, DataFrame]:
    """The dated pairs, abnormal returns and volumes per instrument and event day, and the rejected pairs.

    Only the instruments of ``pairs`` are read, each over the days its own
    events need. ``market`` holds bars with returns of the index. ``closes`` is
    the index of last closes (``refresh_closes``); without it one is made from all ticks.
    """
    windows = settle(event_windows(events.select("ipo_id", "event_date"), calendar, spec), "windows")
    paired = settle(pair_events(pairs, events, windows), "paired")
    spans = settled_spans(instrument_span(paired))
    opens = closes_before(daily_closes(ticks) if closes is None else closes, spans)
    bars = bar_returns(resample_bars(ticks_in_span(ticks, spans), freq), opens=opens)
    aligned = settle(align_market(bars, market), "aligned")
    lazy = event_series(aligned, calendar, paired, spec, volume_method, min_obs)
    series = Settled(settle(lazy.frame, "series"), lazy.rows, lazy.values)
    outcomes = pair_outcomes(pairs, events, windows, aligned, calendar, spec, min_obs)
    return paired, series, event_rejects(outcomes)


def with_earlier_rejects(rejects: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """``rejects`` of a run over ``pairs`` with those stored at ``path`` whose pair the run did not try.

    A pair is an id and the rival's full code, or its spelling where that is no code.
    """
    spark = rejects.sparkSession
    try:
        stored = spark.read.schema(rejects.schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return rejects
    keys = ["ipo_id", "rival"]
    tried = pairs.select("ipo_id", F.coalesce(full_code(F.col("rival_stkcd")), F.col("rival_stkcd")).alias("rival"))
    earlier = stored.withColumn("rival", F.coalesce("rival_fc", "rival_stkcd"))
    return rejects.unionByName(pending_items(earlier, tried, keys).drop("rival"))


def cut_pairs(
    spark: SparkSession, paths: dict[str, str], paired: DataFrame, series: Settled, times: DataFrame, cut: CutSpec, resume: bool
) -> DataFrame:
    """Windows of the pairs of a run, cut from their series, and with ``resume`` those that a lost run left out.

    Pairs that have event bars but no windows are cut from the bars stored for them, whose keys alone
    are looked through. To be called before the bars of the run are added to these.
    """
    if not resume:
        return cuts_of_pairs(*distinct_cuts(paired, series, times, cut))
    pending = pending_filter(spark, paths["event_windows"], KEYS)
    fresh = cuts_of_pairs(*distinct_cuts(pending(paired.select(*KEYS)), series, times, cut))
    try:
        known = finished_keys(spark, paths["event_bars"], KEYS)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return fresh
    left = settled(pending(known), "left")
    if not left.rows:
        return fresh
    bars = read_event_bars(spark, paths["event_bars"]).join(left.broadcastable(), KEYS, "left_semi")
    return fresh.unionByName(window_cuts_wide(bars, times, cut))


def summarise(
    spark: SparkSession, paths: dict[str, str], times: DataFrame, cut: CutSpec, resume: bool, wide: DataFrame | None = None
) -> None:
    """Bring windows, means and yearly statistics up to date with the stored event bars.

    ``wide`` has the windows to add (:func:`cut_pairs`); without it they are cut from the stored bars.
    With ``resume`` only pairs without windows are cut, and only the years they
    fall in are averaged and summarised again: means are stored by ``event_year`` and statistics by
    ``year``, and files of other years stay. The years are noted before windows are added, so a run
    that is lost on the way is made up for by the next.
    """
    if wide is None:
        bars = read_event_bars(spark, paths["event_bars"])
        todo = pending_filter(spark, paths["event_windows"], KEYS)(bars) if resume else bars
        wide = settle(window_cuts_wide(todo, times, cut), "wide")
    years = wide.select(F.year("event_date").alias("event_year")).distinct()
    if resume:
        try:
            years = years.union(spark.read.schema("event_year int").parquet(paths["open_years"])).distinct()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    # one row per year
    years = settle(years, "years")
    sink_overwrite(years, paths["open_years"])
    (sink_append if resume else sink_overwrite)(wide, paths["event_windows"])
    every = spark.read.schema(wide.schema).parquet(paths["event_windows"]).withColumn("event_year", F.year("event_date"))
    means = rival_mean(every.join(F.broadcast(years), "event_year", "left_semi").drop("event_year"))
    dated = means.withColumn("event_year", F.year("event_date"))
    # without resume nothing of an earlier study may stay
    write = replace_partitions if resume else lambda df, path, by: sink_overwrite(df, path, partition_by=by)
    write(dated, paths["event_windows_mean"], ["event_year"])
    stored = spark.read.schema(dated.schema).parquet(paths["event_windows_mean"])
    write(year_stats(stored.join(F.broadcast(years), "event_year", "left_semi").drop("event_year")), paths["year_stats"], ["year"])
    sink_overwrite(years.limit(0), paths["open_years"])


def run_event_study(
    ticks: DataFrame,
    market: DataFrame,
    calendar: DataFrame,
    pairs: DataFrame,
    index: DataFrame,
    times: DataFrame,
    output: str,
    spec: StudySpec = StudySpec(),
    cut: CutSpec = CutSpec(),
    freq: str = FREQ,
    resume: bool = False,
    volume_method: str = "diff",
    min_obs: int = 2,
    closes: str | None = None,
) -> dict[str, str]:
    """Run the study and write its tables; returns their paths by name.

    Each stage is read back from its table, so a lost executor repeats no
    earlier stage; tables made on the way are removed at the end. With
    ``resume`` pairs already in the output are skipped and new results are
    appended; where there is no output yet, it is a first run. A resumed run costs
    what its new pairs and their years cost (:func:`summarise`); it must have the times, ``spec`` and ``cut`` of the first. Rejects of
    earlier runs stay unless their pair is tried again; they are written before
    results, so that a run that fails between the two tries those pairs again.
    The index of last closes at ``closes`` (below the output if not given) is brought up to date first,
    from the newest day on that it has.
    """
    spark = ticks.sparkSession
    names = ("event_bars", "rejects", "event_windows", "event_windows_mean", "year_stats", "open_years")
    paths = {name: f"{output.rstrip('/')}/{name}" for name in names}
    closes = closes or f"{output.rstrip('/')}/closes"
    with scratch_scope(spark):
        events = settle(first_events(index), "events")
        if resume:
            coded = pairs.withColumn("rival_fc", full_code(F.col("rival_stkcd")))
            pending = pending_filter(spark, paths["event_bars"], ["ipo_id", "rival_fc"])
            pairs = settle(pending(coded).select(*pairs.columns), "pending")
        stored = refresh_closes(ticks, closes)
        paired, series, rejects = study_series(
            ticks, market, calendar, pairs, events, spec, freq, volume_method, min_obs, stored)
        if resume:
            rejects = settle(with_earlier_rejects(rejects, pairs, paths["rejects"]), "rejects")
        sink_overwrite(rejects, paths["rejects"])
        wide = settle(cut_pairs(spark, paths, paired, series, times, cut, resume), "wide")
        (sink_append if resume else sink_overwrite)(bars_of_pairs(paired, series), paths["event_bars"])
        summarise(spark, paths, times, cut, resume, wide)
    return paths

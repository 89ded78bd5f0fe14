"""Bars in buckets are not moved, and ticks of other days and venues are not opened."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from eventlens import schemas
from eventlens.operators.abnormal import abnormal_bars
from eventlens.operators.calendar import StudySpec, trading_calendar
from eventlens.operators.pairs import ticks_in_span
from eventlens.sources.layouts import store_bucketed, store_ticks, stored_ticks_in_span

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
SPEC = StudySpec(estimation=((-8, -4), (-4, -2), (-2, -2)), event=(-1, 1))


def walk(plan, path=()):
    """Every operator of a physical plan with those above it, nearest first."""
    yield plan, path
    children = plan.children()
    for i in range(children.size()):
        yield from walk(children.apply(i), (plan.nodeName(), *path))


def test_bucketed_bars_are_not_moved(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"SH60000{k}", day, dt.datetime.combine(day, dt.time(9, 30 + n)), rng.gauss(0, 1), 1.0, rng.gauss(0, 1))
            for k in range(3) for day in DAYS for n in range(5)]
    aligned = spark.createDataFrame(rows, "instrument string, trade_date date, ts timestamp_ntz, return double, volume double, market_return double")
    calendar = trading_calendar(aligned)
    pairs = spark.createDataFrame([(f"i{n}", f"SH60000{n % 3}", DAYS[12 + n]) for n in range(9)], "ipo_id string, rival_fc string, event_date date")
    stored = store_bucketed(aligned, "bars_in_buckets", str(tmp_path / "bars"), 4)
    try:
        key = lambda df: sorted(map(str, df.collect()))
        got = abnormal_bars(stored, calendar, pairs, SPEC)
        assert key(got.select("ipo_id", "timestamp")) == key(abnormal_bars(aligned, calendar, pairs, SPEC).select("ipo_id", "timestamp"))
        settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
        before = {k: spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
                plan = abnormal_bars(stored, calendar, pairs, SPEC)._jdf.queryExecution().executedPlan()
                scans = [path for node, path in walk(plan) if node.nodeName().startswith("Scan") and "Bucketed: true" in node.toString()]
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert len(scans) == 2, "once for the sums and once for the bars of events"
        for path in scans:
            # partial and final sums, or the join with what events want
            merging = [i for i, name in enumerate(path) if name in ("SortMergeJoin", "ShuffledHashJoin") or name.endswith("HashAggregate")]
            done = merging[1] if path[merging[0]].endswith("HashAggregate") else merging[0]
            assert not [name for name in path[:done] if name in ("Exchange", "ShuffleExchange")], path
    finally:
        spark.sql("DROP TABLE IF EXISTS bars_in_buckets")


def ticks_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet") and "tick_id" in node.toString():
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


@pytest.fixture
def spans(spark):
    rows = [("SH600000", DAYS[2], DAYS[4]), ("SZ000001", DAYS[20], DAYS[21]), ("SZ000002", DAYS[20], DAYS[20])]
    return spark.createDataFrame(rows, "rival_fc string, first_day date, last_day date")


def test_only_files_of_spans_are_opened(spark, spans, tmp_path):
    names = ["SH600000", "SH600001", "SZ000001", "BJ830001"]
    rows = [(n, dt.datetime.combine(day, dt.time(9, 30)), i, 1.0, 1.0) for i, n in enumerate(names) for day in DAYS]
    ticks, path = spark.createDataFrame(rows, schemas.TICKS), str(tmp_path / "ticks")
    store_ticks(ticks, path)
    store_ticks(ticks.where(ticks.ts < dt.datetime(2024, 1, 5)), path)
    got = stored_ticks_in_span(spark, path, spans)
    want = ticks_in_span(ticks, spans)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 5
    # of 120 rows in 90 folders those of the five days, without the venue of no span
    assert ticks_read(got) == [15]
    assert stored_ticks_in_span(spark, path, spans.limit(0)).collect() == []

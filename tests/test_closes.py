"""The close before the first bar of a span, from the index of closes, however long ago."""

from __future__ import annotations

import datetime as dt

import pytest

from eventlens import schemas
from eventlens.operators.bars import bar_returns, resample_bars
from eventlens.operators.closes import closes_before, daily_closes, last_indexed_day, read_closes, refresh_closes
from eventlens.operators.pairs import ticks_in_span

DAY = dt.datetime(2020, 6, 1, 10)
AGO = {"SH600000": [400, 200, 200, 0, 1], "SZ000001": [90, 3, 0, 1], "SZ000002": [0, 1], "SZ000003": [31, 0], "SZ000004": [500]}


@pytest.fixture(scope="module")
def ticks(spark):
    rows = []
    for name, days in AGO.items():
        for n, back in enumerate(days):
            at = DAY + dt.timedelta(days=back if back == 1 else -back, minutes=n)
            rows.append((name, at, len(rows), 10.0 + 3 * n + len(rows), 1.0))
    return spark.createDataFrame(rows, schemas.TICKS)


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(name, DAY.date(), DAY.date() + dt.timedelta(days=0 if name == "SZ000003" else 2)) for name in [*AGO, "SZ999999"]]
    return spark.createDataFrame(rows, "rival_fc string, first_day date, last_day date")


def test_first_return_after_a_long_gap(ticks, spans):
    of = lambda found: sorted(tuple(r) for r in found.collect())
    inside = lambda df: df.where((df.ts >= DAY) & (df.instrument != "SZ000004"))
    want = of(inside(bar_returns(resample_bars(ticks))))
    near = ticks_in_span(ticks, spans)
    assert near.where(near.ts < DAY).isEmpty()
    got = of(bar_returns(resample_bars(near), opens=closes_before(daily_closes(ticks), spans)))
    assert got == want and {r[0] for r in got if r[-1] is None} == {"SZ000002"}


def test_no_tick_before_the_bounds_is_read(spark, ticks, spans, tmp_path):
    """Even where a rival never traded before."""
    path = str(tmp_path / "ticks")
    ticks.write.parquet(path)
    plan = ticks_in_span(spark.read.parquet(path), spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2, "the ticks once and the spans once"
    assert "GreaterThanOrEqual(ts,2020-06-01" in plan


def test_index_is_refreshed_from_its_newest_day(spark, ticks, tmp_path):
    path = str(tmp_path / "closes")
    early = ticks.where(ticks.ts < DAY)
    assert read_closes(spark, path) is None and last_indexed_day(spark, path) is None
    refresh_closes(early, path)
    files = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "closes").rglob("part-*")}
    before = files()
    for _ in range(2):  # the second time nothing is new
        found = refresh_closes(ticks, path)
        want = sorted(map(tuple, daily_closes(ticks).collect()))
        assert sorted(map(tuple, found.collect())) == want
    newest = max(DAY.date() - dt.timedelta(days=b) for days in AGO.values() for b in days if b > 1)
    kept = {f.name for d in (tmp_path / "closes").iterdir() if d.name < f"day={newest}" and d.is_dir() for f in d.glob("part-*")}
    assert kept and all(before[name] == files()[name] for name in kept)


def test_no_ticks(spark, ticks, spans, tmp_path):
    none = ticks.limit(0)
    assert refresh_closes(none, str(tmp_path / "none")).collect() == []
    assert closes_before(daily_closes(none), spans).collect() == []
    assert ticks_in_span(ticks, spans.limit(0)).collect() == []
    assert closes_before(daily_closes(ticks), spans.limit(0)).collect() == []

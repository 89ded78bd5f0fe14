"""Running sums against estimates over whole windows, also after days were added."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators.calendar import StudySpec, trading_calendar
from eventlens.operators.estimation import estimates
from eventlens.operators.running import estimates_from_running, refresh_running, running_moments

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
SPEC = StudySpec(estimation=((-20, -9), (-8, -4), (-3, -3)), event=(0, 1))
SCHEMA = "instrument string, trade_date date, ts timestamp_ntz, return double, volume double, market_return double"


@pytest.fixture(scope="module")
def aligned(spark):
    rng, rows = random.Random(3), []
    for name in ("A", "B", "FLAT", "STEPS", "LATE"):
        for i, day in enumerate(DAYS):
            if (name == "B" and i % 5 == 2) or (name == "LATE" and i < 25):
                continue
            for k in range(4):
                # a market that never moves, and one that moves between days only, now and then
                market = {"FLAT": 0.1, "STEPS": (i // 7) / 100}.get(name, 0.1 + rng.gauss(0, 1e-6))
                y = None if k == 2 else float("nan") if (name, i) == ("A", 11) else rng.gauss(0, 0.01)
                rows.append((name, day, dt.datetime.combine(day, dt.time(9, 30 + k)), y, None if k == 3 else rng.random(), market))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def calendar(spark):
    return trading_calendar(spark.createDataFrame([(d,) for d in DAYS], "trade_date date"))


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(n, d) for n in ("A", "B", "FLAT", "STEPS", "LATE", "NONE") for d in DAYS[5:]], "instrument string, event_date date")


def same(got, want):
    left, right = ({(r.instrument, r.event_date): r.asDict() for r in df.collect()} for df in (got, want))
    assert set(left) == set(right) and len(left) > 100
    for key, row in right.items():
        for name, value in row.items():
            mine = left[key][name]
            assert mine == value if not isinstance(value, float) else mine == pytest.approx(value, rel=1e-6, abs=1e-9), (key, name)


def test_equals_estimates(aligned, calendar, requests):
    want = estimates(aligned, calendar, requests, SPEC)
    assert want.where("beta_est1 IS NULL AND n_est1 > 1").count() > 5 and want.where("beta_est1 IS NOT NULL").count() > 20
    same(estimates_from_running(running_moments(aligned, calendar), calendar, requests, SPEC), want)


def test_days_are_added_without_the_earlier_ones(spark, aligned, calendar, requests, tmp_path):
    path, want = str(tmp_path / "running"), estimates(aligned, calendar, requests, SPEC)
    stamp = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "running").rglob("part-*")}
    assert refresh_running(aligned.limit(0), calendar, str(tmp_path / "none")) is not None
    refresh_running(aligned.where(F.col("trade_date") < F.lit(DAYS[18])), calendar, path)
    before = stamp()
    for first in (18, 30, 30):
        found = refresh_running(aligned.where(F.col("trade_date") >= F.lit(DAYS[first])), calendar, path)
        same(estimates_from_running(found, calendar, requests, SPEC), want)
    assert all(stamp()[f] == t for f, t in before.items())
    assert refresh_running(aligned.limit(0), calendar, path).count() == found.count()

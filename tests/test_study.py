from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlens import schemas
from eventlens.operators import abnormal, bars, cuts, estimation, pairs, rollup, selection
from eventlens.operators.calendar import StudySpec, event_windows, nth_trading_day, trading_calendar
from eventlens.plans import event_study as study
from eventlens.plans.event_study import run_event_study

START = dt.date(2024, 1, 1)
DAYS = [START + dt.timedelta(days=i) for i in range(40) if (START + dt.timedelta(days=i)).weekday() < 5]
SPEC = StudySpec(estimation=((-8, -4), (-4, -2), (-2, -2)), event=(-1, 1))


@pytest.fixture(scope="module")
def calendar(spark):
    rows = [(d,) for d in DAYS + DAYS[:3]]
    random.Random(1).shuffle(rows)
    return trading_calendar(spark.createDataFrame(rows, "trade_date date"))


def bar_times(day):
    return [dt.datetime.combine(day, dt.time(9, 25)) + dt.timedelta(minutes=5 * i) for i in range(8)]


@pytest.fixture(scope="module")
def aligned(spark):
    """Random returns of two instruments; Z has a constant market return on its first days."""
    rng, rows = random.Random(7), []
    for name in ("SH600000", "SZ000001"):
        for day in DAYS:
            for i, ts in enumerate(bar_times(day)):
                r = None if i == 3 else rng.gauss(0, 0.01)
                rows.append((name, day, ts, r, float(rng.randint(1, 50)), rng.gauss(0, 0.01)))
    for day in DAYS:
        for ts in bar_times(day):
            rows.append(("SH600009", day, ts, rng.gauss(0, 0.01), 1.0, 0.1))
    schema = "instrument string, trade_date date, ts timestamp_ntz, `return` double, volume double, market_return double"
    return spark.createDataFrame(rows, schema)


def test_calendar_numbers_days(calendar):
    got = [(r.trade_date, r.day_idx) for r in calendar.orderBy("day_idx").collect()]
    assert got == [(d, i) for i, d in enumerate(DAYS, 1)]


def test_offsets(spark, calendar):
    events = spark.createDataFrame(
        [("a", DAYS[10]), ("b", dt.date(2024, 1, 6)), ("c", DAYS[0]), ("d", DAYS[-1])], "ipo_id string, event_date date"
    )
    there = nth_trading_day(events, calendar, {"x": 3}).select("ipo_id", F.col("x").alias("event_date"))
    back = {r.ipo_id: r.y for r in nth_trading_day(there.dropna(), calendar, {"y": -3}).collect()}
    assert back == {"a": DAYS[10], "c": DAYS[0]}
    # a weekend, and offsets off either end, drop the event
    kept = event_windows(events, calendar, SPEC).collect()
    assert [r.ipo_id for r in kept] == ["a"]
    assert (kept[0].est1_start, kept[0].est3_end, kept[0].event_end) == (DAYS[2], DAYS[8], DAYS[11])


def test_resample_ties_and_returns(spark):
    at = dt.datetime(2024, 1, 1, 9, 30, 10)
    ticks = [
        ("A", at, 2, 11.0, 1.0), ("A", at, 9, 12.0, 2.0), ("A", at, -5, 13.0, 1.0),
        ("A", at + dt.timedelta(minutes=5), 1, 0.0, 1.0),
        ("A", at + dt.timedelta(days=1), 3, 6.0, 1.0),
        ("A", at + dt.timedelta(days=1, minutes=7), 4, 9.0, 1.0),
    ]
    df = spark.createDataFrame(ticks, schemas.TICKS)
    got = bars.bar_returns(bars.resample_bars(df, "5 minutes")).orderBy("ts").collect()
    assert [r.price for r in got] == [12.0, 0.0, 6.0, 9.0]
    assert [r.volume for r in got] == [4.0, 1.0, 1.0, 1.0]
    # no earlier bar, a fall to zero, after a zero price, within the second day
    assert [r["return"] for r in got] == [None, -1.0, None, 0.5]


def test_returns_do_not_depend_on_chunks(spark, sf):
    from eventlens.catalog import fixtures as fx

    resampled = bars.resample_bars(fx.ticks(spark, sf), "1 hour").cache()
    one = {(r.instrument, r.ts): r["return"] for r in bars.bar_returns(resampled, "day").collect()}
    two = {(r.instrument, r.ts): r["return"] for r in bars.bar_returns(resampled, "year").collect()}
    assert one == two and len(one) > 500


def test_daily_sums_equal_regression(spark, calendar, aligned):
    requests = spark.createDataFrame(
        [(n, d) for n in ("SH600000", "SZ000001") for d in DAYS[9:20]] * 3, "instrument string, event_date date"
    )
    got = estimation.estimates(aligned, calendar, requests, SPEC).toPandas().set_index(["instrument", "event_date"])
    assert len(got) == 22
    raw = aligned.toPandas()
    index = {d: i for i, d in enumerate(DAYS)}
    for (name, day), row in got.iterrows():
        for k, (first, last) in enumerate(SPEC.estimation, 1):
            offset = raw["trade_date"].map(index) - index[day]
            part = raw[(raw["instrument"] == name) & (offset >= first) & (offset <= last)]
            both = part.dropna(subset=["return", "market_return"])
            slope, intercept = np.polyfit(both["market_return"], both["return"], 1)
            assert row[f"n_est{k}"] == len(both)
            assert row[f"beta_est{k}"] == pytest.approx(slope, abs=1e-9)
            assert row[f"alpha_est{k}"] == pytest.approx(intercept, abs=1e-9)
            assert row[f"vol_mean_est{k}"] == pytest.approx(part["volume"].mean(), abs=1e-9)
            left = both["return"] - row[f"alpha_est{k}"] - row[f"beta_est{k}"] * both["market_return"]
            assert left.sum() == pytest.approx(0, abs=1e-9)


def test_constant_market_has_no_slope(spark, calendar, aligned):
    requests = spark.createDataFrame([("SH600009", DAYS[12]), ("none", DAYS[12])], "instrument string, event_date date")
    got = {r.instrument: r for r in estimation.estimates(aligned, calendar, requests, SPEC).collect()}
    assert got["SH600009"].beta_est1 is None and got["SH600009"].alpha_est1 is None
    assert got["SH600009"].vol_mean_est1 == 1.0
    assert got["none"].n_est1 == 0 and got["none"].vol_mean_est2 is None


def test_user_model_equals_market_model(spark, calendar, aligned):
    requests = spark.createDataFrame([("SH600000", DAYS[12]), ("SZ000001", DAYS[15])], "instrument string, event_date date")

    def least_squares(est: pd.DataFrame, event: pd.DataFrame) -> pd.Series:
        both = est.dropna(subset=["return", "market_return"])
        slope, intercept = np.polyfit(both["market_return"], both["return"], 1)
        return intercept + slope * event["market_return"]

    own = abnormal.modelled_returns(aligned, calendar, requests, least_squares, SPEC).toPandas()
    windows = requests.select(F.col("instrument").alias("ipo_id"), F.col("instrument").alias("rival_fc"), "event_date")
    built_in = abnormal.abnormal_bars(aligned, calendar, windows, SPEC).toPandas()
    merged = own.merge(built_in, left_on=["instrument", "ts"], right_on=["rival_fc", "timestamp"])
    assert len(merged) == len(own) == len(built_in) == 2 * 3 * 8
    for k in SPEC.numbers:
        np.testing.assert_allclose(merged[f"ar_est{k}_x"], merged[f"ar_est{k}_y"], atol=1e-9)


def test_volume_methods(spark, calendar, aligned):
    windows = spark.createDataFrame([("i", "SH600000", DAYS[12])], "ipo_id string, rival_fc string, event_date date")
    diff = abnormal.abnormal_bars(aligned, calendar, windows, SPEC).orderBy("timestamp").toPandas()
    share = abnormal.abnormal_bars(aligned, calendar, windows, SPEC, "ratio").orderBy("timestamp").toPandas()
    base = estimation.volume_baseline(
        aligned, calendar, windows.withColumnRenamed("rival_fc", "instrument"), SPEC
    ).first()["vol_mean_est2"]
    np.testing.assert_allclose(diff["av_est2"] / base, share["av_est2"])
    with pytest.raises(ValueError):
        abnormal.abnormal_volume_col(1, "other")


def test_market_beyond_the_bound_is_not_broadcast(spark, aligned):
    market = aligned.where("instrument = 'SH600000'").select("ts", F.col("market_return").alias("return"))
    stock = aligned.select("instrument", "ts", "return")
    small = bars.align_market(stock, market)
    large = bars.align_market(stock, market, max_bytes=100)
    assert "rightHint=(strategy=broadcast)" in small._jdf.queryExecution().toString().replace(" ", "") or (
        "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().toString()
    )
    assert "strategy=broadcast" not in large._jdf.queryExecution().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def event_rows():
    """Bars of one event: three days of eight bars, NULL values in places."""
    rng, rows = random.Random(3), []
    for day in DAYS[9:12]:
        for i, ts in enumerate(bar_times(day)):
            ar = None if i == 2 else rng.gauss(0, 1)
            rows.append(("i1", "SH600000", DAYS[10], ts, ar, ar, None, rng.gauss(0, 1), 1.0, None))
    return rows


def brute_cuts(rows, start, end, spec):
    """Expected sums by plain lists."""
    rows = sorted(rows, key=lambda r: r[3])
    stamp = lambda m: dt.datetime.combine(DAYS[10], dt.time(m // 60, m % 60))
    chosen = {"full_day": [r for r in rows if stamp(spec.day_open) <= r[3] <= stamp(spec.day_close)]}
    for label, n in spec.spans:
        chosen[f"before_start_{label}"] = [] if start is None else [r for r in rows if r[3] < stamp(start)][-n:]
        chosen[f"after_start_{label}"] = [] if start is None else [r for r in rows if r[3] >= stamp(start)][:n]
        chosen[f"after_end_{label}"] = [] if end is None else [r for r in rows if r[3] >= stamp(end)][:n]
    out = {}
    for w, inside in chosen.items():
        for variant in cuts.VARIANTS:
            kept = [r for r in inside if variant == "with925" or (r[3].hour, r[3].minute) != divmod(spec.excluded, 60)]
            for k in (1, 2, 3):
                for metric, at in (("car", 3 + k), ("cav", 6 + k)):
                    values = [r[at] for r in kept if r[at] is not None]
                    out[f"{metric}_{w}_{variant}_est{k}"] = sum(values) if values else None
    return out


@pytest.mark.parametrize(
    "start,end", [(570, 585), (565, 1200), (500, 480), (1000, 1100), (None, 570), (580, None), (571, 566)]
)
def test_cuts_against_lists(spark, start, end):
    rows = event_rows()
    df = spark.createDataFrame(rows, schemas.EVENT_BARS)
    times = spark.createDataFrame([("i1", start, end)], "ipo_id string, start_minute int, end_minute int")
    got = cuts.window_cuts_wide(df, times).first().asDict()
    want = brute_cuts(rows, start, end, cuts.CutSpec())
    assert set(got) - set(cuts.KEYS) == set(want) and len(want) == 84
    for name, value in want.items():
        assert got[name] == (None if value is None else pytest.approx(value, abs=1e-9)), name


def test_cuts_without_times_and_with_null_keys(spark):
    rows = event_rows()
    df = spark.createDataFrame(rows + [(None, *rows[0][1:])], schemas.EVENT_BARS)
    times = spark.createDataFrame([("other", 1, 2)], "ipo_id string, start_minute int, end_minute int")
    got = cuts.window_cuts_wide(df, times).collect()
    assert len(got) == 1
    assert got[0]["car_before_start_1hr_with925_est1"] is None and got[0]["car_full_day_with925_est1"] is not None


def test_cuts_use_one_shuffle(spark):
    df = spark.createDataFrame(event_rows(), schemas.EVENT_BARS)
    times = spark.createDataFrame([("i1", 570, 600)], "ipo_id string, start_minute int, end_minute int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cuts.window_cuts_wide(df, times)._jdf.queryExecution().executedPlan().toString()
        limited = cuts.bars_before(cuts.attach_times(df, times), cuts.KEYS, "event_start", 6)
        limited_plan = limited._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    # rows beyond n are dropped before the shuffle
    assert limited_plan.count("WindowGroupLimit") == 2


def test_long_names(spark):
    df = spark.createDataFrame([("car_full_day_no925_est2",), ("car_total",), ("other",)], "name string")
    got = [tuple(r) for r in df.select(*rollup.parsed_name(F.col("name"))).collect()]
    assert got == [("car", "full_day", "no925", 2), ("car", "car_total", None, None), ("other", "other", None, None)]


def test_year_stats(spark):
    rng = random.Random(5)
    rows = [(f"i{i}", dt.date(2020 + i % 2, 1, 1 + i % 20), rng.gauss(0, 1), None) for i in range(60)]
    rows.append(("x", dt.date(2023, 5, 5), 4.0, None))
    df = spark.createDataFrame(rows, "ipo_id string, event_date date, car_a double, cav_b double")
    got = {(r.year, r.window): r for r in rollup.year_stats(df).collect()}
    assert len(got) == 6
    for year in (2020, 2021):
        values = [r[2] for r in rows if r[1].year == year]
        row = got[(year, "car_a")]
        assert row.p95 == pytest.approx(np.quantile(values, 0.95)) and row.p5 == pytest.approx(np.quantile(values, 0.05))
        assert row["std"] == pytest.approx(statistics.stdev(values)) and row["max"] == max(values)
    assert got[(2023, "car_a")]["std"] is None and got[(2023, "car_a")]["p95"] == 4.0
    assert got[(2020, "cav_b")]["mean"] is None and got[(2020, "cav_b")]["p5"] is None


@pytest.mark.parametrize("kind", ["distinct", "ties", "hot"])
def test_group_quantiles(spark, kind):
    rng = random.Random(11)
    draw = {"distinct": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 5)), "hot": lambda: rng.choice([7.0] * 9 + [rng.random()])}
    rows = [(g, draw[kind]()) for g, n in (("a", 5000), ("b", 17), ("c", 1)) for _ in range(n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}
    got = {r.g: r for r in rollup.group_quantiles(df, ["g"], "v", probs, buckets=16).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, row in got.items():
        values = [v for name, v in rows if name == g and v is not None]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-12), (g, name)


def test_pairs_and_rejects(spark, calendar):
    sheet = spark.createDataFrame([("a", DAYS[12]), ("b", DAYS[1]), ("c", None)], "ipo_id string, event_date date")
    events = sheet.dropna()
    given = spark.createDataFrame(
        [("a", "1", "600000"), ("a", "1", "600000"), ("a", "1", "300001"), ("b", "2", "600000"), ("c", "3", "600000"), ("z", "9", "1")],
        schemas.PAIRS,
    )
    windows = event_windows(events, calendar, SPEC)
    dated = pairs.pair_events(given, events)
    assert sorted((r.ipo_id, r.rival_fc) for r in dated.collect()) == [
        ("a", "SH600000"), ("a", "SZ300001"), ("b", "SH600000"),
    ]
    assert pairs.pair_events(given, events, windows).count() == 2


def test_spellings_of_a_code_are_one_pair(spark):
    events = spark.createDataFrame([("a", DAYS[12])], "ipo_id string, event_date date")
    rows = [("a", "9", code) for code in ("1", "000001", " 1", "01", "600000", "x")]
    got = pairs.pair_events(spark.createDataFrame(rows, schemas.PAIRS), events).collect()
    assert sorted(r.rival_fc for r in got) == ["SH600000", "SZ000001"]


def test_outcome_of_every_pair(spark, calendar):
    """One rival per reason, and one that yields a result."""
    events = spark.createDataFrame([("a", DAYS[12]), ("b", DAYS[1]), ("c", None)], "ipo_id string, event_date date")
    windows = event_windows(events.dropna(), calendar, SPEC)
    have = {"600000": range(len(DAYS)), "600001": range(12), "600002": [12], "600003": [len(DAYS) - 1]}
    have["600001"] = range(11)
    rows = []
    for code, days in have.items():
        for i in days:
            for ts in bar_times(DAYS[i]):
                rows.append((f"SH{code}", ts, DAYS[i], random.Random(i).random(), 1.0, random.Random(ts.minute).random()))
    aligned = spark.createDataFrame(
        rows, "instrument string, ts timestamp_ntz, trade_date date, return double, volume double, market_return double")
    given = [("a", "9", c) for c in [*have, "600004", "n/a", "x"]] + [("b", "8", "600000"), ("c", "7", "600000"), ("z", "6", "600000")]
    found = pairs.pair_outcomes(
        spark.createDataFrame(given + given, schemas.PAIRS), events, windows, aligned, calendar, SPEC)
    got = {(r.ipo_id, r.rival_stkcd): r.reason for r in found.collect()}
    assert found.count() == len(got) == len(given)
    assert got == {
        ("a", "600000"): None, ("a", "600001"): "no event bars", ("a", "600002"): "no estimate", ("a", "600003"): "no data",
        ("a", "600004"): "no data", ("a", "n/a"): "bad code", ("a", "x"): "bad code",
        ("b", "600000"): "no window", ("c", "600000"): "no event", ("z", "600000"): "no event",
    }
    assert pairs.event_rejects(found).count() == len(given) - 1


def test_nan_is_no_value(spark, calendar, aligned):
    nan = float("nan")
    asked = spark.createDataFrame([("SH600000", DAYS[12])], "instrument string, event_date date")
    spoiled = aligned.withColumn("return", F.when(F.col("trade_date") == F.lit(DAYS[7]), nan).otherwise(F.col("return"))).withColumn(
        "volume", F.when(F.col("trade_date") == F.lit(DAYS[7]), nan).otherwise(F.col("volume")))
    cleared = aligned.withColumn("return", F.when(F.col("trade_date") != F.lit(DAYS[7]), F.col("return"))).withColumn(
        "volume", F.when(F.col("trade_date") != F.lit(DAYS[7]), F.col("volume")))
    first, second = (estimation.estimates(df, calendar, asked, SPEC).first() for df in (spoiled, cleared))
    assert first == second and first["beta_est1"] is not None
    ticks = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 2, 9, 30), 1, 5.0, nan), ("A", dt.datetime(2024, 1, 2, 9, 31), 2, 6.0, 2.0),
         ("A", dt.datetime(2024, 1, 2, 9, 36), 3, nan, 1.0)], schemas.TICKS)
    got = [tuple(r)[2:] for r in bars.resample_bars(ticks).orderBy("ts").collect()]
    assert got == [(6.0, 2.0), (None, 1.0)]
    rows = event_rows()
    bad = [(*r[:4], *[nan if v is None else v for v in r[4:]]) for r in rows]
    times = spark.createDataFrame([("i1", 570, 585)], "ipo_id string, start_minute int, end_minute int")
    frames = [cuts.window_cuts_wide(spark.createDataFrame(r, schemas.EVENT_BARS), times).first() for r in (rows, bad)]
    assert frames[0] == frames[1]


def test_regression_keeps_digits(spark, calendar):
    """Market returns of 0.1 that move by 1e-9: sums of squares alone would lose the slope."""
    rng, rows = random.Random(4), []
    for day in DAYS:
        for ts in bar_times(day):
            step = rng.uniform(-1e-9, 1e-9)
            rows.append(("SH600000", ts, day, 0.05 + 2 * step, 1.0, 0.1 + step))
    aligned = spark.createDataFrame(
        rows, "instrument string, ts timestamp_ntz, trade_date date, return double, volume double, market_return double")
    asked = spark.createDataFrame([("SH600000", DAYS[12])], "instrument string, event_date date")
    got = estimation.market_model(aligned, calendar, asked, SPEC).first()
    for k in SPEC.numbers:
        assert got[f"beta_est{k}"] == pytest.approx(2, rel=1e-6)


def test_times_that_repeat_an_id_do_not_multiply_bars(spark):
    df = spark.createDataFrame(event_rows(), schemas.EVENT_BARS)
    times = spark.createDataFrame([("i1", 580, 590), ("i1", 570, 600)], "ipo_id string, start_minute int, end_minute int")
    got = cuts.attach_times(df, times)
    assert got.count() == df.count()
    assert {r.event_start.minute for r in got.collect()} == {30}


def test_nested_events_split_a_hot_instrument(spark):
    rows = [(f"i{n}", "HOT", DAYS[n % 5], DAYS[0], DAYS[6]) for n in range(500)] + [("j", "COLD", DAYS[1], DAYS[0], DAYS[6])]
    df = spark.createDataFrame(rows, "ipo_id string, rival_fc string, event_date date, est1_start date, event_end date")
    got = pairs.events_nested(df, target=50).collect()
    hot = [r for r in got if r.rival_fc == "HOT"]
    assert len(hot) == 10 and max(len(r.events) for r in hot) < 100
    assert sorted(e.ipo_id for r in hot for e in r.events) == sorted(f"i{n}" for n in range(500))
    for r in got:
        assert r.events == sorted(r.events, key=lambda e: (e.event_date, e.ipo_id))


def test_align_series(spark):
    one = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 2.0)], "k string, t int, value double")
    two = spark.createDataFrame([("k", 2, 5.0), ("m", 3, 6.0)], "k string, t int, value double")
    got = sorted(tuple(r) for r in bars.align_series({"a": one, "b": two}, ["k", "t"]).collect())
    assert got == [("k", 1, 1.0, None), ("k", 2, 2.0, 5.0), ("m", 3, None, 6.0)]


def test_selection(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("b", None, None)], "k string, n int, e double")
    assert sorted(tuple(r)[:2] for r in selection.keep_first(df, ["k"], [F.col("n").asc_nulls_last()]).collect()) == [
        ("a", 1), ("b", None),
    ]
    assert selection.drop_all_null_columns(df, ["n", "e"]).columns == ["k", "n"]
    done = spark.createDataFrame([("a",), ("a",)], "k string")
    assert [r.k for r in selection.pending_items(df, done, ["k"]).collect()] == ["b"]


def test_whole_study_and_resume(spark, calendar, tmp_path):
    rng, ticks, n = random.Random(9), [], 0
    for name in ("SH600000", "SZ000001", "SH000300"):
        for day in DAYS:
            for ts in bar_times(day):
                n += 1
                ticks.append((name, ts + dt.timedelta(seconds=rng.randint(0, 200)), n, 10 + rng.random(), float(rng.randint(1, 9))))
    all_ticks = spark.createDataFrame(ticks, schemas.TICKS)
    market = bars.bar_returns(bars.resample_bars(all_ticks.where("instrument = 'SH000300'")))
    index = spark.createDataFrame([("a", "9", DAYS[12]), ("a", "9", DAYS[15]), ("b", "8", DAYS[14])],
                                  "ipo_id string, ipo_stkcd_raw string, roadshow_date date")
    times = spark.createDataFrame([("a", 570, 590), ("b", None, 575)], "ipo_id string, start_minute int, end_minute int")
    given = [("a", "9", "600000"), ("b", "8", "600000"), ("b", "8", "1"), ("b", "8", "2")]
    stocks = all_ticks.where("instrument <> 'SH000300'")
    out = str(tmp_path / "study")

    def run(rows, resume):
        pairs_df = spark.createDataFrame(rows, schemas.PAIRS)
        return run_event_study(stocks, market, calendar, pairs_df, index, times, out, SPEC, resume=resume)

    # without an output, resuming is a first run
    paths = run(given[:2], True)
    assert spark.read.parquet(paths["event_bars"]).count() == 2 * 3 * 8
    run(given, True)
    stored = spark.read.parquet(paths["event_bars"])
    assert stored.count() == 3 * 3 * 8 and stored.distinct().count() == 3 * 3 * 8
    assert {r.event_date for r in stored.where("ipo_id = 'a'").collect()} == {DAYS[12]}
    assert [r.rival_fc for r in spark.read.parquet(paths["rejects"]).collect()] == ["SZ000002"]
    # a resumed pair reads its own instrument's span alone
    spans = spark.createDataFrame([("SZ000001", DAYS[3], DAYS[9])], "rival_fc string, first_day date, last_day date")
    near = pairs.ticks_in_span(stocks, spans)
    assert {r.instrument for r in near.collect()} == {"SZ000001"}
    days = {r.ts.date() for r in near.collect()}
    assert min(days) == DAYS[3] and max(days) == DAYS[9]
    path = str(tmp_path / "ticks")
    stocks.write.parquet(path)
    plan = pairs.ticks_in_span(spark.read.parquet(path), spans)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert spark.read.parquet(paths["event_windows"]).count() == 3
    assert spark.read.parquet(paths["event_windows_mean"]).count() == 2
    assert spark.read.parquet(paths["year_stats"]).count() == 84


def test_rejects_outlive_a_resumed_run(spark, calendar, tmp_path):
    """A pair without estimate counts as finished; its reason must not be lost, nor repeated."""
    day = DAYS[12]
    at = {"SH600000": DAYS, "SZ000001": [day], "SZ000002": [], "SZ000003": [DAYS[-1]]}
    ticks = spark.createDataFrame(
        [(name, ts, n, 10.0 + (n * 7 + i) % 5, 1.0) for i, (name, days) in enumerate(at.items()) for d in days for n, ts in enumerate(bar_times(d))],
        schemas.TICKS)
    market = bars.bar_returns(bars.resample_bars(ticks.where("instrument = 'SH600000'")))
    index = spark.createDataFrame([("a", "9", day)], "ipo_id string, ipo_stkcd_raw string, roadshow_date date")
    times = spark.createDataFrame([("a", 570, 590)], "ipo_id string, start_minute int, end_minute int")
    spec = StudySpec(estimation=((-8, -4), (-4, -3), (-3, -2)), event=(-1, 1))
    out = str(tmp_path / "study")

    def run(codes):
        rows = [("a", "9", c) for c in codes]
        paths = run_event_study(ticks, market, calendar, spark.createDataFrame(rows, schemas.PAIRS), index, times, out, spec, resume=True)
        return sorted((r.rival_stkcd, r.reason) for r in spark.read.parquet(paths["rejects"]).collect())

    first = run(["600000", "1", "n/a"])
    assert first == [("1", "no estimate"), ("n/a", "bad code")]
    # other pairs, the same ones again, and one that is tried again
    second = run(["2", "600000", "1"])
    assert second == [("1", "no estimate"), ("2", "no data"), ("n/a", "bad code")]
    assert run(["000001", "2", "n/a", "3"]) == [*second[:2], ("3", "no data"), second[2]]


def test_summaries_of_other_years_stay_and_lost_ones_are_made_up(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    dates = [dt.date(y, 3, d) for y in (2021, 2022, 2023) for d in (3, 4)]
    names = ["event_bars", "event_windows", "event_windows_mean", "year_stats", "open_years"]
    whole, parts = ({n: str(tmp_path / k / n) for n in names} for k in ("whole", "parts"))
    times = spark.createDataFrame([(f"i{d}", 570, 590) for d in dates], "ipo_id string, start_minute int, end_minute int")
    rows = [(f"i{d}", f"SH60000{k}", d, ts, *[rng.gauss(0, 1) for _ in range(6)]) for d in dates for k in range(3) for ts in bar_times(d)]
    of = lambda test: spark.createDataFrame([r for r in rows if test(r)], schemas.EVENT_BARS)
    of(lambda r: True).write.parquet(whole["event_bars"])
    study.summarise(spark, whole, times, cuts.CutSpec(), False)

    def add(test):
        of(test).write.mode("append").parquet(parts["event_bars"])
        study.summarise(spark, parts, times, cuts.CutSpec(), True)

    files = lambda year: sorted(
        (f.name, f.stat().st_mtime_ns) for p, c in (("event_windows_mean", "event_year"), ("year_stats", "year"))
        for f in (tmp_path / "parts" / p / f"{c}={year}").glob("part-*"))
    add(lambda r: r[2].year == 2021 or (r[2].year == 2022 and r[1].endswith("0")))
    before = files(2021)
    add(lambda r: r[2].year == 2022 and not r[1].endswith("0"))
    assert before and files(2021) == before
    # lost after the windows of 2023 are added: the next run finds its year open
    monkeypatch.setattr(study, "rival_mean", lambda wide: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        add(lambda r: r[2].year == 2023)
    monkeypatch.undo()
    study.summarise(spark, parts, times, cuts.CutSpec(), True)
    assert files(2021) == before

    def near(name):
        left, right = (sorted(map(tuple, spark.read.parquet(p[name]).collect()), key=lambda r: tuple(map(str, r[:2] + r[-1:] + r[2:5]))) for p in (whole, parts))
        assert len(left) == len(right) > 0
        key = lambda r: [v if v is None or not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in r]
        for row in left:
            assert any(key(row) == list(other) for other in right), row[:3]

    for name in ("event_windows", "event_windows_mean"):
        near(name)
    assert spark.read.parquet(parts["year_stats"]).count() == spark.read.parquet(whole["year_stats"]).count() == 3 * 84


def test_pairs_multiply_in_many_tasks(spark, calendar, aligned, monkeypatch):
    """Many pairs on few instruments and days: bars are made where they are ranked, in more than one task."""
    rows = [(f"i{n}", name, DAYS[n % 3 + 12]) for n in range(300) for name in ("SH600000", "SZ000001")]
    paired = spark.createDataFrame(rows, "ipo_id string, rival_fc string, event_date date").coalesce(1)
    times = spark.createDataFrame([(f"i{n}", 9 * 60 + 40, None) for n in range(300)], "ipo_id string, start_minute int, end_minute int")
    monkeypatch.setattr(abnormal, "BARS_PER_TASK", 2000, raising=False)
    found = abnormal.abnormal_bars(aligned, calendar, paired, SPEC)
    assert found.count() == 600 * 3 * 8
    used = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) == -(-600 * 3 * 8 // 2000) and max(r["count"] for r in used) < 2 * 2000
    chosen = cuts.bars_before(cuts.attach_times(found, times), cuts.KEYS, "event_start", 6)
    chosen.collect()
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    ranked = final[final.index("WindowGroupLimit"):]
    assert ranked.index("BroadcastHashJoin") < ranked.index("Exchange"), "bars are not moved between join and ranking"


@pytest.mark.parametrize("small", [True, False])
def test_pairs_of_equal_windows_are_cut_once(spark, calendar, aligned, monkeypatch, small):
    """Windows cut per series and position are those cut from every pair's own bars; many pairs share one cut."""
    if not small:
        for module in (abnormal, cuts):
            monkeypatch.setattr(module, "fits", lambda df, rows: False)
    names = ("SH600000", "SZ000001")
    rows = [(f"i{n}", name, DAYS[n % 3 + 12]) for n in range(120) for name in names]
    paired = spark.createDataFrame(rows, "ipo_id string, rival_fc string, event_date date")
    minutes = [None, 0, 9 * 60 + 30, 9 * 60 + 31, 9 * 60 + 42, 10 * 60, 1439]
    # events without times, with one of the two, before the first and after the last bar; some twice
    times = spark.createDataFrame(
        [(f"i{n}", minutes[n % 7], minutes[5 * (n // 7 % 2)]) for n in range(110)] + [("i5", 1439, 1439), ("other", 1, 2)],
        "ipo_id string, start_minute int, end_minute int")
    series = abnormal.event_series(aligned, calendar, paired, SPEC)
    members, sums = cuts.distinct_cuts(paired, series, times)
    assert members.rows == len(rows) and sums.rows < len(rows) / 2
    read = lambda df: {tuple(r[k] for k in cuts.KEYS): r.asDict() for r in df.collect()}
    got, want = read(cuts.cuts_of_pairs(members, sums)), read(cuts.window_cuts_wide(abnormal.bars_of_pairs(paired, series), times))
    assert got.keys() == want.keys() and len(got) == len(rows)
    for key, row in want.items():
        assert set(got[key]) == set(row)
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (key, name)


def test_windows_of_a_lost_run_are_made_up(spark, calendar, tmp_path, monkeypatch):
    """A run lost after its event bars are stored: the next cuts them from there, beside its own pairs."""
    rng, ticks = random.Random(8), []
    for name in ("SH600000", "SZ000001", "SZ000002", "SH000300"):
        for n, ts in enumerate(t for day in DAYS for t in bar_times(day)):
            ticks.append((name, ts, n, 10 + rng.random(), float(rng.randint(1, 9))))
    ticks = spark.createDataFrame(ticks, schemas.TICKS)
    market = bars.bar_returns(bars.resample_bars(ticks.where("instrument = 'SH000300'")))
    index = spark.createDataFrame([("a", "9", DAYS[12]), ("b", "8", DAYS[14])], "ipo_id string, ipo_stkcd_raw string, roadshow_date date")
    times = spark.createDataFrame([("a", 570, 590), ("b", None, 575)], "ipo_id string, start_minute int, end_minute int")
    given = [("a", "9", "600000"), ("b", "8", "600000"), ("b", "8", "1"), ("a", "9", "2")]

    def run(rows, out, resume=True):
        return run_event_study(ticks, market, calendar, spark.createDataFrame(rows, schemas.PAIRS), index, times, str(tmp_path / out), SPEC, resume=resume)

    run(given[:1], "parts")
    monkeypatch.setattr(study, "summarise", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(given[:3], "parts")
    monkeypatch.undo()
    parts, whole = run(given, "parts"), run(given, "whole", False)
    for name, keys, n in (("event_windows", cuts.KEYS, 4), ("event_windows_mean", cuts.KEYS[::2], 2)):
        left, right = ({tuple(r[k] for k in keys): r.asDict() for r in spark.read.parquet(p[name]).collect()} for p in (parts, whole))
        assert left.keys() == right.keys() and len(left) == n == spark.read.parquet(parts[name]).count()
        for key, row in right.items():
            assert left[key] == {c: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for c, v in row.items()}

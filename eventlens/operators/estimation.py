"""Market model and volume baseline per instrument and event day.

Both depend only on the instrument and the event day, so they are computed
once per distinct such pair, however many events share it. Bars are first
summed to one row per instrument and day; the estimation windows are then
range frames over the day number, at most one row per calendar day each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.functions.nulls import number
from eventlens.operators.calendar import StudySpec

SUMS = ["n", "dx", "dy", "cxx", "cxy", "vol_n", "vol_sum"]


def daily_partials(aligned: DataFrame) -> DataFrame:
    """Moments and volume sums per instrument and trading day.

    ``x`` is the market return and ``y`` the stock return of bars where both
    are present: their number, means, and centred sums of squares and products,
    which Spark combines without cancellation. NaN is NULL.
    """
    stock, market = number(F.col("return")), number(F.col("market_return"))
    both = stock.isNotNull() & market.isNotNull()
    x, y = F.when(both, market), F.when(both, stock)
    volume = number(F.col("volume"))
    return aligned.groupBy("instrument", "trade_date").agg(
        F.count(x).alias("n"),
        F.avg(x).alias("x_mean"),
        F.avg(y).alias("y_mean"),
        (F.var_pop(x) * F.count(x)).alias("mxx"),
        (F.covar_pop(x, y) * F.count(x)).alias("mxy"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.count(volume).alias("vol_n"),
        F.sum(volume).alias("vol_sum"),
    )


def _centred(daily: DataFrame) -> DataFrame:
    """Daily moments about the instrument's mean returns ``x_mid, y_mid``.

    A window adds these up; what is left to subtract is the small distance of
    the window's mean from the instrument's, not the square of the mean itself.
    """
    whole = Window.partitionBy("instrument")
    mid = [
        (F.sum(F.col("n") * F.col(f"{v}_mean")).over(whole) / F.sum("n").over(whole)).alias(f"{v}_mid") for v in "xy"
    ]
    x, y, n = F.col("x_mean") - F.col("x_mid"), F.col("y_mean") - F.col("y_mid"), F.col("n")
    return daily.select("*", *mid).withColumns({
        "dx": n * x, "dy": n * y, "cxx": F.col("mxx") + n * x * x, "cxy": F.col("mxy") + n * x * y,
    })


def _slope(k: int, min_obs: int) -> Column:
    n, dx, dy, cxx, cxy = (F.col(f"{c}_{k}") for c in ("n", "dx", "dy", "cxx", "cxy"))
    # a market that does not move leaves the slope undefined; comparing the
    # extremes is exact where the difference of sums is not
    defined = (n >= min_obs) & (F.col(f"x_min_{k}") < F.col(f"x_max_{k}"))
    return F.when(defined, F.try_divide(cxy - dx * dy / n, cxx - dx * dx / n))


def estimates(
    aligned: DataFrame,
    calendar: DataFrame,
    requests: DataFrame,
    spec: StudySpec = StudySpec(),
    min_obs: int = 2,
) -> DataFrame:
    """Estimation results for each distinct ``(instrument, event_date)`` of ``requests``.

    Per window k: ``n_est{k}, alpha_est{k}, beta_est{k}, vol_n_est{k},
    vol_mean_est{k}``. Slope and intercept are NULL below ``min_obs``
    observations or when the market return is constant.
    """
    days = F.broadcast(calendar)
    measures = [*SUMS, "x_min", "x_max", "x_mid", "y_mid"]
    daily = _centred(daily_partials(aligned)).join(days, "trade_date").select(
        "instrument", "day_idx", *measures, F.lit(None).cast("date").alias("event_date")
    )
    asked = (
        requests.select("instrument", "event_date")
        .distinct()
        .join(days.withColumnRenamed("trade_date", "event_date"), "event_date")
        .select("instrument", "day_idx", "event_date")
    )
    both = daily.unionByName(asked, allowMissingColumns=True)
    framed = []
    for k, (first, last) in enumerate(spec.estimation, 1):
        frame = Window.partitionBy("instrument").orderBy("day_idx").rangeBetween(first, last)
        framed += [F.sum(c).over(frame).alias(f"{c}_{k}") for c in SUMS]
        framed += [F.min("x_min").over(frame).alias(f"x_min_{k}")]
        framed += [F.max("x_max").over(frame).alias(f"x_max_{k}")]
        framed += [F.max(f"{v}_mid").over(frame).alias(f"{v}_mid_{k}") for v in "xy"]
    sums = both.select("instrument", "event_date", *framed).where(F.col("event_date").isNotNull())
    betas = sums.select("*", *[_slope(k, min_obs).alias(f"beta_est{k}") for k in spec.numbers])
    outputs = [
        (
            F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_est{k}"),
            (
                F.col(f"y_mid_{k}") + F.try_divide(F.col(f"dy_{k}"), F.col(f"n_{k}"))
                - F.col(f"beta_est{k}") * (F.col(f"x_mid_{k}") + F.try_divide(F.col(f"dx_{k}"), F.col(f"n_{k}")))
            ).alias(f"alpha_est{k}"),
            F.col(f"beta_est{k}"),
            F.coalesce(F.col(f"vol_n_{k}"), F.lit(0)).alias(f"vol_n_est{k}"),
            F.try_divide(F.col(f"vol_sum_{k}"), F.col(f"vol_n_{k}")).alias(f"vol_mean_est{k}"),
        )
        for k in spec.numbers
    ]
    return betas.select("instrument", "event_date", *reduce(lambda a, b: a + b, outputs))


def market_model(
    aligned: DataFrame, calendar: DataFrame, requests: DataFrame,
    spec: StudySpec = StudySpec(), min_obs: int = 2,
) -> DataFrame:
    """Intercept and slope of stock on market return per estimation window."""
    cols = [f"{c}_est{k}" for k in spec.numbers for c in ("n", "alpha", "beta")]
    return estimates(aligned, calendar, requests, spec, min_obs).select(
        "instrument", "event_date", *cols
    )


def volume_baseline(
    aligned: DataFrame, calendar: DataFrame, requests: DataFrame, spec: StudySpec = StudySpec()
) -> DataFrame:
    """Mean bar volume per estimation window."""
    cols = [f"{c}_est{k}" for k in spec.numbers for c in ("vol_n", "vol_mean")]
    return estimates(aligned, calendar, requests, spec).select("instrument", "event_date", *cols)

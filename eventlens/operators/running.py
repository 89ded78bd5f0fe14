"""Running moments per instrument: a window's regression is a difference of two rows.

A table with one row per instrument and trading day holds all sums up to that
day. Any estimation window is then looked up at its two ends, however long
it is, and new days are added to the table without going back over old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from eventlens.operators.calendar import StudySpec
from eventlens.operators.estimation import SUMS, daily_partials
from eventlens.session import settle
from eventlens.sources.sinks import replace_partitions

# Beside the sums: the means they are about, observations before the market's
# present run of equal returns, the last of these, and whether its day had others.
RUNNING = (
    "instrument string, day_idx int, n bigint, dx double, dy double, cxx double, cxy double, vol_n bigint, vol_sum double, "
    "x_ref double, y_ref double, n_before_run bigint, last_x double, last_mixed boolean, trade_date date"
)
_STATE = ["x_ref", "y_ref", "n_before_run", "last_x", "last_mixed"]


def running_moments(aligned: DataFrame, calendar: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows of the running table for the days of ``aligned``, in the columns of RUNNING.

    Returns are summed about a reference of their instrument, the mean of the first
    rows it was seen in, so that differences of sums keep their digits. ``before`` has the last
    row of each instrument from an earlier table (see :func:`last_rows`); its sums and
    reference are carried on. NaN is NULL. An instrument has at most one row per calendar day,
    so its rows are ordered in one task.
    """
    daily = daily_partials(aligned).join(F.broadcast(calendar), "trade_date")
    whole = Window.partitionBy("instrument")
    means = {v: F.try_divide(F.sum(F.col("n") * F.col(f"{v}_mean")).over(whole), F.sum("n").over(whole)) for v in "xy"}
    fresh = daily.withColumn("carried", F.lit(False)).withColumns({f"{v}_own": m for v, m in means.items()})
    if before is not None:
        fresh = fresh.unionByName(before.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    else:
        fresh = fresh.withColumns({c: F.lit(None).cast("double") for c in ("x_ref", "y_ref", "last_x", "dx", "dy", "cxx", "cxy")}).withColumns(
            {"n_before_run": F.lit(None).cast("bigint"), "last_mixed": F.lit(None).cast("boolean")})
    # the earlier row's reference, else the instrument's own mean
    ref = {f"{v}_ref": F.coalesce(F.max(f"{v}_ref").over(whole), F.max(f"{v}_own").over(whole)) for v in "xy"}
    known = fresh.withColumns(ref)
    n, x, y = F.col("n"), F.col("x_mean") - F.col("x_ref"), F.col("y_mean") - F.col("y_ref")
    about = {"dx": n * x, "dy": n * y, "cxx": F.col("mxx") + n * x * x, "cxy": F.col("mxy") + n * x * y}
    centred = known.withColumns({c: F.when(F.col("carried"), F.col(c)).otherwise(e) for c, e in about.items()})
    order = Window.partitionBy("instrument").orderBy("day_idx")
    up_to, earlier = (order.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    mixed = F.when(F.col("carried"), F.col("last_mixed")).otherwise(F.col("x_min") < F.col("x_max"))
    seen = F.when(n > 0, F.struct(F.when(F.col("carried"), F.col("last_x")).otherwise(F.col("x_max")).alias("x"), mixed.alias("mixed")))
    walked = centred.withColumn("seen", seen).withColumns({
        "previous": F.last("seen", True).over(earlier), "latest": F.last("seen", True).over(up_to),
        **{f"run_{c}": F.coalesce(F.sum(c).over(up_to), F.lit(0)) for c in SUMS},
    })
    # a run of equal market returns goes on where neither day had other ones and both are the same
    goes_on = ~F.col("previous.mixed") & ~F.col("seen.mixed") & (F.col("previous.x") == F.col("seen.x"))
    first = F.when(F.col("carried"), F.col("n_before_run")).when((n > 0) & ~F.coalesce(goes_on, F.lit(False)), F.when(
        F.col("seen.mixed"), F.col("run_n")).otherwise(F.col("run_n") - n))
    told = walked.withColumn("start", first).withColumn("before_run", F.coalesce(F.last("start", True).over(up_to), F.lit(0)))
    return told.where(~F.col("carried")).select(
        "instrument", F.col("day_idx").cast("int"), *[F.col(f"run_{c}").alias(c) for c in SUMS], "x_ref", "y_ref",
        F.col("before_run").alias("n_before_run"), F.col("latest.x").alias("last_x"), F.col("latest.mixed").alias("last_mixed"), "trade_date",
    )


def last_rows(running: DataFrame, before: Column | None = None) -> DataFrame:
    """The newest row of each instrument, of those on days before ``before`` if it is given."""
    rows = running if before is None else running.where(F.col("trade_date") < before)
    fields = [c for c in running.columns if c not in ("instrument", "trade_date")]
    found = rows.groupBy("instrument").agg(F.max_by(F.struct(*fields), "day_idx").alias("r"))
    return found.select("instrument", "r.*")


def read_running(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where there is none."""
    try:
        return spark.read.schema(RUNNING).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def refresh_running(aligned: DataFrame, calendar: DataFrame, path: str) -> DataFrame | None:
    """Carry the table at ``path`` on with the days of ``aligned`` and return it.

    Days are partitions. All rows from the first day of ``aligned`` on must be in it; they replace what
    is stored of their days, and earlier days give one row per instrument and
    are otherwise neither read nor computed again. Repeating a run changes nothing.
    None where nothing is stored and nothing came.
    """
    spark = aligned.sparkSession
    stored = read_running(spark, path)
    before = None
    if stored is not None:
        first = aligned.agg(F.min("trade_date")).first()[0]
        if first is None:
            return stored
        before = settle(last_rows(stored, F.lit(first)), "before")
    replace_partitions(settle(running_moments(aligned, calendar, before), "running"), path, ["trade_date"])
    return read_running(spark, path)


def estimates_from_running(
    running: DataFrame, calendar: DataFrame, requests: DataFrame, spec: StudySpec = StudySpec(), min_obs: int = 2,
) -> DataFrame:
    """``estimates`` of each distinct ``(instrument, event_date)`` of ``requests``, from the running table.

    Every window asks for the newest row up to its last day and for the newest
    before its first; the difference of the two is the window. One shuffle by
    instrument serves all lookups, and none depends on the length of a window.
    """
    ends = {f"{side}{k}": day for k, (first, last) in enumerate(spec.estimation, 1) for side, day in (("low", first - 1), ("high", last))}
    asked = (
        requests.select("instrument", "event_date").distinct()
        .join(F.broadcast(calendar.withColumnRenamed("trade_date", "event_date")), "event_date")
        .select("instrument", "event_date", F.col("day_idx").alias("event_idx"), F.explode(F.create_map(
            *[F.lit(v) for item in ends.items() for v in item])).alias("side", "offset"))
        .select("instrument", (F.col("event_idx") + F.col("offset")).cast("int").alias("day_idx"), F.lit(1).alias("kind"), "event_date", "side")
    )
    fields = [*SUMS, *_STATE]
    rows = running.select("instrument", "day_idx", F.lit(0).alias("kind"), F.struct(*fields).alias("row"))
    order = Window.partitionBy("instrument").orderBy("day_idx", "kind")
    met = rows.unionByName(asked, allowMissingColumns=True).withColumn("row", F.last("row", True).over(order))
    found = met.where(F.col("kind") == 1).groupBy("instrument", "event_date").agg(
        *[F.max(F.when(F.col("side") == side, F.col("row"))).alias(side) for side in ends],
    )
    out = []
    for k in spec.numbers:
        at = lambda c, low=f"low{k}", high=f"high{k}": (
            F.coalesce(F.col(f"{high}.{c}"), F.lit(0)) - F.coalesce(F.col(f"{low}.{c}"), F.lit(0)))
        n, dx, dy = at("n"), at("dx"), at("dy")
        # observations before the run of equal market returns that are inside the window make it move
        moves = F.col(f"high{k}.n_before_run") > F.coalesce(F.col(f"low{k}.n"), F.lit(0))
        slope = F.when((n >= min_obs) & moves, F.try_divide(at("cxy") - dx * dy / n, at("cxx") - dx * dx / n))
        level = F.col(f"high{k}.y_ref") + F.try_divide(dy, n) - slope * (F.col(f"high{k}.x_ref") + F.try_divide(dx, n))
        out += [
            n.alias(f"n_est{k}"), level.alias(f"alpha_est{k}"), slope.alias(f"beta_est{k}"),
            at("vol_n").alias(f"vol_n_est{k}"), F.try_divide(at("vol_sum"), at("vol_n")).alias(f"vol_mean_est{k}"),
        ]
    return found.select("instrument", "event_date", *out)

"""Means over rivals and statistics per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.session import settle

VALUE_PREFIXES = ("car_", "cav_")


def value_columns(df: DataFrame, prefixes: tuple[str, ...] = VALUE_PREFIXES) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def rival_mean(wide: DataFrame) -> DataFrame:
    """Mean of every value column per event, NULLs left out."""
    keys = ["ipo_id", "event_date"]
    values = value_columns(wide)
    return wide.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values])


def parsed_name(name: Column) -> list[Column]:
    """``metric, window, variant, est`` read from a value column name.

    A name of another form keeps itself as window and its first part as
    metric, with NULL variant and estimation.
    """
    pattern = "^(car|cav)_(.+)_(with925|no925)_est(\\d+)$"
    matched = name.rlike(pattern)

    def piece(i: int) -> Column:
        return F.when(matched, F.regexp_extract(name, pattern, i))

    return [
        F.coalesce(piece(1), F.substring_index(name, "_", 1)).alias("metric"),
        F.coalesce(piece(2), name).alias("window"),
        piece(3).alias("variant"),
        piece(4).cast("int").alias("est"),
    ]


def long_values(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Value columns as rows ``(keys, name, value)``; NULL values are kept."""
    return df.unpivot(keys, value_columns(df), "name", "value")


def year_stats(means: DataFrame) -> DataFrame:
    """Mean, max, min, sample deviation, 95th and 5th percentile per year and column.

    Percentiles are exact and interpolated; no year is gathered in one task.
    ``means`` should be a stored table, since it is read twice.
    """
    values = value_columns(means)
    dated = means.select(F.year("event_date").alias("year"), *values).where(F.col("year").isNotNull())
    keys = ["year", "name"]
    rows = long_values(dated, ["year"])
    plain = [
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
        F.stddev_samp("value").alias("std"),
    ]
    quantiles = group_quantiles(rows, keys, "value", {"p95": 0.95, "p5": 0.05})
    stats = rows.groupBy(*keys).agg(*plain).join(quantiles, keys, "left")
    return stats.select("year", *parsed_name(F.col("name")), "mean", "max", "min", "std", "p95", "p5")


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 64
) -> DataFrame:
    """Exact linearly interpolated quantiles of groups of any size.

    Equal values are first counted together. Approximate quantiles cut each
    group into ``buckets`` value ranges; counts per range locate the wanted
    ranks, and only the ranges that hold them are ranked value by value.
    """
    counted = settle(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    steps = [i / buckets for i in range(1, buckets)]
    edges = counted.groupBy(*keys).agg(
        F.percentile_approx("v", steps, 10_000).alias("edges")
    )
    # number of edges below v; the edge list has a fixed length
    bucket = F.size(F.filter("edges", lambda e: e < F.col("v")))
    placed = counted.join(edges, keys).select(*keys, "v", "c", bucket.alias("bucket"))
    sizes = placed.groupBy(*keys, "bucket").agg(F.sum("c").alias("size"))
    over_group = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys,
        "bucket",
        (
            F.sum("size").over(over_group.orderBy("bucket")) - F.col("size")
        ).alias("below"),
        "size",
        F.sum("size").over(over_group).alias("total"),
    )
    named = F.explode(
        F.array(*[F.struct(F.lit(n).alias("q"), F.lit(p).alias("p")) for n, p in probs.items()])
    )
    wanted = (
        offsets.select("*", named.alias("w"))
        .select("*", ((F.col("total") - 1) * F.col("w.p")).alias("pos"))
        .select("*", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size")))
        .select(*keys, "bucket", "below", F.col("w.q").alias("q"), "pos", "rank")
        .distinct()
    )
    hit = placed.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
    ordered = hit.withColumn(
        "upto", F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    )
    found = ordered.join(wanted, [*keys, "bucket"]).where(
        (F.col("rank") - F.col("below") < F.col("upto"))
        & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("c"))
    )
    # a fraction of 0 leaves one rank, whose value is then both ends
    ends = found.groupBy(*keys, "q", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    interpolated = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == n, interpolated)).alias(n) for n in probs]
    )

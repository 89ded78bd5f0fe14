"""Missing values are NULL. NaN is turned into NULL where data enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(name), F.col(name)).alias(name) if name in floating else F.col(name)
            for name in df.columns
        ]
    )


def number(value: Column) -> Column:
    """A double with NaN as NULL; Spark would rank NaN above every number and sum to it."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as a double, NULL when the divisor is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))

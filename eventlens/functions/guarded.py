"""Scorers that may fail on a row: the row gets no value and its error is told."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "value double, error string"


def scored_or_failed(score: Callable[[pd.Series], pd.Series], values: pd.Series) -> pd.DataFrame:
    """``value, error`` of each of ``values``; a batch that raises is halved until the failing rows stand alone.

    ``k`` failing rows of ``n`` cost about ``2 k log n`` further calls. An error is the exception's
    type and text.
    """
    out = pd.DataFrame({"value": float("nan"), "error": None}, index=values.index).astype({"error": object})
    waiting = [(0, len(values))]
    while waiting:
        first, end = waiting.pop()
        if first == end:
            continue
        part = values.iloc[first:end]
        try:
            found = pd.Series(score(part))
            if len(found) != len(part):
                raise ValueError(f"{len(part)} values were scored and {len(found)} scores returned")
            out.iloc[first:end, 0] = pd.to_numeric(found).to_numpy(float, na_value=float("nan"))
        except Exception as problem:  # noqa: BLE001  whatever a user's model raises
            if end - first == 1:
                out.iloc[first, 1] = f"{type(problem).__name__}: {problem}"
            else:
                middle = (first + end) // 2
                waiting += [(first, middle), (middle, end)]
    return out


def guarded(score: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A column function giving a struct ``value, error`` for each row, by a pandas UDF over ``score``.

    ``score`` takes the rows of a batch and gives one number for each; NaN and
    None are NULL without an error. Rows must not depend on one another, as a batch may be scored in parts.
    """

    def run(values: pd.Series) -> pd.DataFrame:
        out = scored_or_failed(score, values)
        return out.astype({"value": object}).where(out.notna(), None)

    # annotations are texts in this module, so the types are given here
    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, SCHEMA)

"""Explicit input and output schemas. Identifiers are always strings."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()

EVENT_INDEX = _struct(ipo_id=_S, ipo_stkcd=_S, roadshow_date=_S, start_time=_S, end_time=_S)
PAIRS = _struct(ipo_id=_S, ipo_stkcd=_S, rival_stkcd=_S)
TICKS = _struct(instrument=_S, ts=_TS, tick_id=_L, price=_D, size=_D)
SEGMENT = _struct(start=_D, end=_D, text=_S)
TRANSCRIPT = T.StructType(
    [
        T.StructField("file_stem", _S),
        # number of the document's first segment in its recording, 0 when absent
        T.StructField("first_segment", T.IntegerType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)
CALENDAR_FILE = T.StructType([T.StructField("workdays", T.ArrayType(_S))])
EVENT_BARS = _struct(
    ipo_id=_S, rival_fc=_S, event_date=_DATE, timestamp=_TS,
    ar_est1=_D, ar_est2=_D, ar_est3=_D, av_est1=_D, av_est2=_D, av_est3=_D,
)
VOCAL = _struct(
    file_stem=_S, f0_mean=_D, f0_std=_D, rms_mean=_D, rms_std=_D,
    speech_rate=_D, duration_s=_D, error=_S,
)
VERBAL = _struct(
    file_stem=_S, positive_ratio=_D, negative_ratio=_D, uncertain_ratio=_D,
    tone_score=_D, total_words=_L, total_chars=_L, method=_S, error=_S,
)
VISUAL = _struct(
    file_stem=_S, positive_ratio=_D, negative_ratio=_D, neutral_ratio=_D,
    net_positive=_D, frames_analyzed=_L, frames_with_face=_L, method=_S, error=_S,
)

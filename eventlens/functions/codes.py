"""Security codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Venue by leading digits of the six-digit code.
VENUE_BY_PREFIX = {
    "0": "SZ", "3": "SZ", "6": "SH",
    "83": "BJ", "87": "BJ", "88": "BJ", "92": "BJ",
    "90": "SH", "20": "BJ",
}
UNKNOWN_VENUE = "未知交易所"


def padded_code(code: Column) -> Column:
    """Integer-like code as text of at least six digits; NULL if not an integer."""
    digits = code.cast("string").try_cast("bigint").cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))


def venue(code6: Column, unknown: str = UNKNOWN_VENUE) -> Column:
    """Venue of a padded code."""
    picked = F.lit(unknown)
    for prefix, name in VENUE_BY_PREFIX.items():
        picked = F.when(code6.startswith(prefix), name).otherwise(picked)
    return F.when(code6.isNotNull(), picked)


def full_code(code: Column, unknown: str = UNKNOWN_VENUE) -> Column:
    """Venue followed by the padded code, such as ``SZ000089``."""
    code6 = padded_code(code)
    return F.concat(venue(code6, unknown), code6)

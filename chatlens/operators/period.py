"""Reporting period selection (FIL-1, FIL-2, SRC-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import month_key


def month_bounds(year: int, month: int) -> tuple[str, str]:
    """Local ``[first of month, first of next month)`` as timestamp text; December rolls the year."""
    start = f"{month_key(year, month)}-01 00:00:00"
    ny, nm = (int(year) + 1, 1) if int(month) == 12 else (int(year), int(month) + 1)
    return start, f"{month_key(ny, nm)}-01 00:00:00"


def filter_month(messages: DataFrame, year: int, month: int) -> DataFrame:
    """Messages whose local time falls in the month; null times drop out.

    Expressed on the ``month`` column (derived from local time, so equivalent to
    the half-open bounds) so that a landing table partitioned by month is pruned
    at the scan.
    """
    return messages.where(F.col("month") == F.lit(month_key(year, month)))


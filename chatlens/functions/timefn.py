"""Time expressions: epoch -> UTC/local timestamps, month labels (SRC-9/10, SCL-8/9).

All timestamps are TIMESTAMP_NTZ, so nothing here depends on
``spark.sql.session.timeZone``: UTC is built by adding microseconds to the
epoch and local time with ``convert_timezone`` from an explicit zone id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import LOCAL_TIME_ZONE

# Epoch values above this are read as milliseconds (exactly 1e12 is not).
MILLIS_THRESHOLD = 1e12
# Seconds range of years 1..9999, the range Python datetimes accept.
MIN_EPOCH_SECONDS = -62135596800.0
MAX_EPOCH_SECONDS = 253402300800.0

# Python float() syntax for finite numbers (underscores between digits allowed).
FLOAT_TEXT = r"(?U)^\s*[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"


def epoch_to_utc(seconds: Column) -> Column:
    """Epoch seconds (double; > 1e12 means milliseconds) -> UTC TIMESTAMP_NTZ or null."""
    s = F.when(seconds > F.lit(MILLIS_THRESHOLD), seconds / F.lit(1000.0)).otherwise(seconds)
    in_range = (s >= F.lit(MIN_EPOCH_SECONDS)) & (s < F.lit(MAX_EPOCH_SECONDS))
    micros = F.bround(s * F.lit(1_000_000.0), 0).try_cast("long")
    return F.when(in_range, F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def utc_to_local(utc: Column, zone: str = LOCAL_TIME_ZONE) -> Column:
    """UTC TIMESTAMP_NTZ -> wall-clock TIMESTAMP_NTZ in ``zone``; null if the local year leaves 1..9999."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.when(F.year(local).between(1, 9999), local)


def month_of(local: Column) -> Column:
    """``YYYY-MM`` of a local timestamp; null stays null (SRC-10)."""
    return F.date_format(local, "yyyy-MM")


def month_label(month: Column) -> Column:
    """``YYYY-MM`` -> ``MM-YYYY`` (SCL-8)."""
    return F.concat(F.substring(month, 6, 2), F.lit("-"), F.substring(month, 1, 4))


def minute_text(local: Column) -> Column:
    """``YYYY-MM-DD HH:MM``; ``""`` for null (SCL-9)."""
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(""))


def month_key(year: int, month: int) -> str:
    """Validated reporting period -> ``YYYY-MM`` (SRC-15, FIL-1)."""
    if not (1 <= int(month) <= 12):
        raise ValueError(f"month must be 1..12, got {month}")
    if not (1 <= int(year) <= 9999):
        raise ValueError(f"year out of range: {year}")
    return f"{int(year):04d}-{int(month):02d}"

"""Column names and schemas shared by the package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.fixed_values import REPORT_CAPTIONS
from .functions.timefn import epoch_to_utc, month_of, utc_to_local

# Flat message table, one row per message (DM-4).
MESSAGE_COLUMNS = [
    "account", "conversation_id", "conversation_title", "message_id", "role", "author", "text",
    "create_time_utc", "create_time_local", "date", "month", "department",
]
MESSAGES_DDL = (
    "account string, conversation_id string, conversation_title string, message_id string, role string, "
    "author string, text string, create_time_utc timestamp_ntz, create_time_local timestamp_ntz, date date, "
    "month string, department string"
)
CONVERSATION_KEYS = ["account", "department", "conversation_id", "conversation_title"]
REPORT_COLUMNS = [name for name, _ in REPORT_CAPTIONS]
REPORT_CAPTION_MAP = dict(REPORT_CAPTIONS)


def with_times(raw: DataFrame, seconds_col: str = "epoch_seconds") -> DataFrame:
    """Add UTC/local times, local date and ``YYYY-MM`` month from epoch seconds, then
    project the message columns in their fixed order (SRC-9, SRC-10)."""
    utc = epoch_to_utc(F.col(seconds_col))
    out = raw.withColumn("_utc", utc).withColumn("create_time_local", utc_to_local(F.col("_utc")))
    # A time whose local wall clock is out of range is no time at all (both stay null).
    out = out.withColumn("create_time_utc", F.when(F.col("create_time_local").isNotNull(), F.col("_utc")))
    out = out.withColumn("date", F.to_date(F.col("create_time_local"))).withColumn(
        "month", month_of(F.col("create_time_local")))
    return out.select(*MESSAGE_COLUMNS)

"""Aggregations: per conversation, overview, by department, by department x topic (AGG-1..AGG-4).

Every aggregate here is decomposable (min/max/count/sum) or a single exact
distinct count, so Spark plans a map-side partial aggregate before the shuffle:
a hot department or conversation is pre-combined inside each task and only one
partial row per key and task crosses the network. Exact distinct counts are
planned as a distinct-on-(key, value) partial aggregate first, so the shuffle is
keyed on (key, value) pairs and a heavy key is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONVERSATION_KEYS


def day_bit(date_col: str = "date") -> F.Column:
    """Bit ``day-of-month - 1`` of a date (0 for a null date): a month's active days as a 31-bit set."""
    return F.expr(f"coalesce(shiftleft(1L, dayofmonth(`{date_col}`) - 1), 0L)")


def conversation_stats(month_df: DataFrame, period_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per (account, department, conversation id, title) with time span and counters (AGG-1).

    Null keys form their own group. ``total_msgs`` counts non-null message ids;
    ``active_days`` counts distinct non-null local dates. When the period is a
    grouping key (``month``), the days are kept as a day-of-month bit set
    (``day_mask``, beside ``message_rows``, OR-ed map-side like any partial aggregate) so department
    active days can be derived from these rows without another scan; otherwise
    an exact distinct count is used.
    """
    keys = list(period_cols) + CONVERSATION_KEYS
    aggs = [
        F.min("create_time_local").alias("first_time"),
        F.max("create_time_local").alias("last_time"),
        F.count_if(F.col("role") == "user").alias("user_prompts"),
        F.count_if(F.col("role") == "assistant").alias("assistant_msgs"),
        F.count("message_id").alias("total_msgs"),
    ]
    if "month" in period_cols:
        out = month_df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("message_rows"),
                                            F.bit_or(day_bit()).alias("day_mask"))
        return out.withColumn("active_days", F.bit_count("day_mask").cast("long"))
    return month_df.groupBy(*keys).agg(*aggs, F.count_distinct("date").alias("active_days"))


def overview(conv_stats: DataFrame) -> DataFrame:
    """One row from the conversations of a period (``conversation_stats`` with the period as
    key): distinct conversation ids, user prompts, message rows, distinct departments (AGG-2)."""
    return conv_stats.agg(
        F.count_distinct("conversation_id").alias("total_conversations"),
        F.coalesce(F.sum("user_prompts"), F.lit(0)).alias("total_prompts"),
        F.coalesce(F.sum("message_rows"), F.lit(0)).alias("total_messages"),
        F.count_distinct("department").alias("departments"),
    )


def by_department(conv_stats: DataFrame, period_cols: tuple[str, ...] = ()) -> DataFrame:
    """Per department (null kept): distinct conversation ids and summed counters (AGG-3)."""
    return conv_stats.groupBy(*period_cols, "department").agg(
        F.count_distinct("conversation_id").alias("conversations"),
        F.sum("user_prompts").alias("user_prompts"),
        F.sum("assistant_msgs").alias("assistant_msgs"),
        F.sum("total_msgs").alias("total_msgs"),
    )


def by_department_topic(prompts: DataFrame, period_cols: tuple[str, ...] = ()) -> DataFrame:
    """Prompt counts per (department, topic) (AGG-4)."""
    return prompts.groupBy(*period_cols, "department", "topic").agg(F.count(F.lit(1)).alias("prompts"))

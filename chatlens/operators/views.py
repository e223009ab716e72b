"""Drill-down views (PRJ-2..PRJ-8, FIL-5, FIL-7, SRT-2/3).

Each view takes an optional department (and conversation) filter; without one
it covers every department, ordered by department first. Ordering is a global
``orderBy`` (range-partitioned sort), never a per-department window, so a hot
department is still sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import SPEAKER_OTHER, SPEAKER_USER
from ..functions.timefn import minute_text
from .enrich import assistant_rows


def _dept(df: DataFrame, department: str | None) -> DataFrame:
    return df if department is None else df.where(F.col("department") == F.lit(department))


def conversation_list(conv_stats: DataFrame, department: str | None = None) -> DataFrame:
    """Conversations of a department by first time (PRJ-2)."""
    return _dept(conv_stats, department).select(
        "department", "conversation_id", "conversation_title", "first_time", "last_time", "user_prompts",
        "assistant_msgs", "total_msgs", "active_days",
    ).orderBy("department", F.asc_nulls_last("first_time"), "conversation_id")


def prompt_list(prompts: DataFrame, department: str | None = None) -> DataFrame:
    """Prompts with tags and scores by time (PRJ-3).

    Pass ``cluster_prompts(prompts)`` to show cluster labels; otherwise ``cluster`` is null.
    """
    df = _dept(prompts, department)
    if "cluster" not in df.columns:
        df = df.withColumn("cluster", F.lit(None).cast("long"))
    return df.select(
        "department", F.col("create_time_local").alias("create_time"), "conversation_title", "text", "topic",
        "purpose", "prompt_quality", "word_count", "cluster", "message_id",
    ).orderBy("department", F.asc_nulls_last("create_time"), "message_id")


def assistant_replies(month_df: DataFrame, department: str | None = None) -> DataFrame:
    """Assistant messages by time (PRJ-4)."""
    return assistant_rows(_dept(month_df, department)).select(
        "department", F.col("create_time_local").alias("create_time"), "conversation_title", "text", "message_id",
    ).orderBy("department", F.asc_nulls_last("create_time"), "message_id")


def department_raw(month_df: DataFrame, department: str | None = None) -> DataFrame:
    """All columns of a department's messages by time (PRJ-5)."""
    return _dept(month_df, department).orderBy("department", F.asc_nulls_last("create_time_local"), "message_id")


def conversation_label(conversation_id, conversation_title):
    """``id – title`` (PRJ-8)."""
    return F.concat_ws(" – ", F.coalesce(conversation_id.cast("string"), F.lit("None")), conversation_title)


def transcript(month_df: DataFrame, department: str | None = None, conversation_id: str | None = None,
               account: str | None = None) -> DataFrame:
    """Messages of a conversation by time: speaker, minute timestamp, text (PRJ-7, FIL-7).

    Matches on department and conversation id (as text); ``account`` optionally
    narrows a conversation id shared by several accounts (D-11).
    """
    df = _dept(month_df, department)
    if conversation_id is not None:
        df = df.where(F.col("conversation_id").cast("string") == F.lit(str(conversation_id)))
    if account is not None:
        df = df.where(F.col("account") == F.lit(account))
    return df.select(
        "department", "conversation_id",
        conversation_label(F.col("conversation_id"), F.col("conversation_title")).alias("conversation_label"),
        "message_id",
        F.when(F.col("role") == "user", F.lit(SPEAKER_USER)).otherwise(F.lit(SPEAKER_OTHER)).alias("speaker"),
        minute_text(F.col("create_time_local")).alias("time_text"),
        "text",
        "create_time_local",
    ).orderBy("department", "conversation_id", F.asc_nulls_last("create_time_local"), "message_id").drop(
        "create_time_local")

"""Row-level enrichment: role flags and prompt tagging/scoring (PRJ-1, FIL-3/4, SCL-1..4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import prompt_quality_sql
from ..functions.rules import RuleSet, default_topic_rules, purpose_rules, tag_sql
from ..functions.text import word_count
from .partitioning import with_text_partitions
from .rule_table import tag_by_table


def with_role_flags(messages: DataFrame) -> DataFrame:
    """``is_user`` / ``is_assistant`` (case-sensitive role equality; null role -> false)."""
    return messages.withColumns({
        "is_user": F.coalesce(F.col("role") == "user", F.lit(False)),
        "is_assistant": F.coalesce(F.col("role") == "assistant", F.lit(False)),
    })


def user_rows(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "user")


def assistant_rows(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "assistant")


def tag_texts(df: DataFrame, text_col: str = "text", topic_rules: RuleSet | DataFrame | None = None,
              purpose: RuleSet | None = None, with_topic: bool = True, with_purpose: bool = True,
              with_quality: bool = True, with_words: bool = True) -> DataFrame:
    """Add topic, purpose, prompt_quality and word_count for a text column.

    ``lower(text)`` and the word count are projected once and shared by every
    rule test (check ``explain``: one ``lower`` per row, not one per keyword).
    Topic rules may be a table (rank, label, keyword), matched by a join (``rule_table``).
    """
    table = topic_rules if isinstance(topic_rules, DataFrame) else None
    topic_rules = default_topic_rules() if topic_rules is None else topic_rules
    purpose = purpose or purpose_rules()
    text = F.col(text_col)
    out = with_text_partitions(df).withColumn("_lt", F.lower(text))
    if with_words or with_quality:
        out = out.withColumn("word_count", word_count(text))
    cols = {}
    if with_topic and table is None:
        cols["topic"] = F.expr(tag_sql("_lt", topic_rules))
    if with_purpose:
        cols["purpose"] = F.when(F.coalesce(text, F.lit("")) == "", F.lit(purpose.fallback)).otherwise(
            F.expr(tag_sql("_lt", purpose)))
    if with_quality:
        cols["prompt_quality"] = F.expr(prompt_quality_sql(f"`{text_col}`", "word_count", "_lt"))
    out = out.withColumns(cols) if cols else out
    out = out.drop("_lt")
    if not with_words and "word_count" in out.columns:
        out = out.drop("word_count")
    return tag_by_table(out, table, "topic", text_col) if with_topic and table is not None else out


def enrich_prompts(month_df: DataFrame, topic_rules: RuleSet | DataFrame | None = None,
                   purpose: RuleSet | None = None) -> DataFrame:
    """User prompts of the period with topic, purpose, quality and word count (DM-7)."""
    return tag_texts(user_rows(month_df), "text", topic_rules, purpose)

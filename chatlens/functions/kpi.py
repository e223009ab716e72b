"""KPI ladder (SCL-5) and per-head score (SCL-6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import KPI_LADDER, KPI_LOW, KPI_NONE


def per_head_score(raw_score: Column, staff: Column) -> Column:
    """``round(raw / staff)`` with half-to-even rounding; 0 when staff <= 0."""
    return F.when(staff > F.lit(0),
                  F.bround(raw_score.cast("double") / staff.cast("double"), 0).cast("long")).otherwise(F.lit(0))


def kpi_ladder_sql(ladder=KPI_LADDER, prompts: str = "prompts", active_days: str = "active_days",
                   unique_topics: str = "unique_topics", avg_messages: str = "avg_prompts_per_conversation",
                   avg_words: str = "avg_words_per_prompt") -> tuple[str, str]:
    """(rating SQL, raw score SQL) of the ladder over column names; standard SQL (Spark and DuckDB)."""
    rating, score = [], []
    for label, sc, p_min, d_min, t_min, m_min, w_min, alt in ladder:
        conds = []
        if p_min is not None:
            c = f"{prompts} >= {p_min}"
            conds.append(f"({c} OR {active_days} >= {alt})" if alt is not None else c)
        if d_min is not None:
            conds.append(f"{active_days} >= {d_min}")
        if t_min is not None:
            conds.append(f"{unique_topics} >= {t_min}")
        if m_min is not None:
            conds.append(f"{avg_messages} >= {m_min}")
        if w_min is not None:
            conds.append(f"{avg_words} >= {w_min}")
        cond = " AND ".join(conds)
        rating.append(f"WHEN {cond} THEN '{label}'")
        score.append(f"WHEN {cond} THEN {sc}")
    r = f"CASE {' '.join(rating)} WHEN {prompts} > 0 THEN '{KPI_LOW[0]}' ELSE '{KPI_NONE[0]}' END"
    s = f"CAST(CASE {' '.join(score)} WHEN {prompts} > 0 THEN {KPI_LOW[1]} ELSE {KPI_NONE[1]} END AS BIGINT)"
    return r, s

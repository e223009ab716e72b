"""Prompt-quality score 0..100 (SCL-2): length band + marker groups, clamped."""

from __future__ import annotations

from .fixed_values import (QUALITY_LENGTH_BANDS, QUALITY_LENGTH_TOP_POINTS, QUALITY_MARKER_GROUPS, QUALITY_MAX,
                           QUALITY_MIN)
from .rules import any_keyword_sql, minimal_keywords


def prompt_quality_sql(text_col: str, words_col: str, lowered_col: str) -> str:
    """SQL text of the score over column names; null or empty text scores 0, blanks only the lowest band."""
    band = ("CASE " + " ".join(f"WHEN {words_col} < {b} THEN {p}" for b, p in QUALITY_LENGTH_BANDS)
            + f" ELSE {QUALITY_LENGTH_TOP_POINTS} END")
    parts = [band]
    for _name, pts, markers in QUALITY_MARKER_GROUPS:
        kws = minimal_keywords(markers)
        parts.append(f"(CASE WHEN {any_keyword_sql(lowered_col, kws)} THEN {pts} ELSE 0 END)")
    total = " + ".join(parts)
    return (f"CAST(CASE WHEN coalesce({text_col}, '') = '' THEN 0 "
            f"ELSE least({QUALITY_MAX}, greatest({QUALITY_MIN}, {total})) END AS BIGINT)")

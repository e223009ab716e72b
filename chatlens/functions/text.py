"""Text column expressions (word count, null-safe strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "word" is a maximal run of characters that Python's str.split() does not
# treat as whitespace: Unicode White_Space plus the separators U+001C..U+001F.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null text counts 0 (SCL-1).

    One regex pass on the JVM (measured within 20 % of the split- and replace-based forms).
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def null_safe_string(c: Column) -> Column:
    """``str(x)`` with null -> ``""`` (SCL-12)."""
    return F.coalesce(c.cast("string"), F.lit(""))

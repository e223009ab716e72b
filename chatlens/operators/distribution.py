"""Labelled share strings per group (AGG-6/7/8, WIN-1, SCL-7, SRT-4).

Inputs are already-aggregated counts, so the rows per group are bounded by the
number of labels in the rule sets, whatever the data size or skew. A group's counts
come together in one array and the share lines are built from it in one pass:
linear in the labels, one shuffle per group key, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_text(n: Column, total: Column) -> Column:
    """Whole-percent text of n/total with half-to-even rounding, e.g. ``12%``."""
    pct = F.bround(n.cast("double") / total.cast("double") * F.lit(100.0), 0).cast("long")
    return F.concat(pct.cast("string"), F.lit("%"))


def lines_sql(pairs: str, total: str) -> str:
    """SQL: column ``array<struct<k: -count, l: label>>`` and the column of their total -> ``+ label (p%)`` lines ordered by
    count descending, then label ascending (D-3), joined by newlines; ``''`` for an empty array. Percent = n / total
    * 100, half-even. One pass over the labels."""
    pct = f"CAST(bround(CAST(-x.k AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0D, 0) AS BIGINT)"
    return (f"array_join(transform(sort_array({pairs}), "
            f"x -> concat('+ ', x.l, ' (', CAST({pct} AS STRING), '%)')), '\\n')")


def distribution_string(counts: DataFrame, keys: list[str], label_col: str, count_col: str = "n",
                        out_col: str = "distribution") -> DataFrame:
    """Group -> newline-joined share lines ordered by count descending, ties by label ascending."""
    pairs = F.collect_list(F.struct((-F.col(count_col).cast("long")).alias("k"), F.col(label_col).alias("l")))
    return counts.groupBy(*keys).agg(pairs.alias("_pairs"), F.sum(F.col(count_col).cast("long")).alias("_total")).select(
        *keys, F.expr(lines_sql("_pairs", "_total")).alias(out_col))

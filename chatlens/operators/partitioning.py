"""Explicit parallelism for CPU-heavy per-row text work."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS_CONF = "spark.chatlens.text.partitions"


def with_text_partitions(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session conf ``spark.chatlens.text.partitions`` says.

    Unset (the default) leaves the scan's splits, which is right for tables of many row groups.
    Set it where tagging is bound by a few large splits that cannot be split further (one
    row group, one file); it costs one round-robin shuffle of the rows. Starts no job.
    """
    n = df.sparkSession.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(n)) if n else df

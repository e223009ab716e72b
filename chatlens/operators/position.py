"""Positions in a global order, without one task for all rows (SRT-2, SRT-3)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` plus ``position`` (from 1) in ``order``, which should name every row apart.

    Rows are dealt by ranges of the order, sorted in each, and written under
    ``spark.checkpoint.dir``; the rows of the ranges before (one number per range)
    are added to a row's place in its own.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/chatlens-position-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    sizes = kept.groupBy(F.shiftright("_place", 33).alias("p")).count().orderBy("p").collect()  # a row per range
    before, pairs = 0, []
    for r in sizes:
        pairs += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    start = F.create_map(*pairs)[F.shiftright("_place", 33)] if pairs else F.lit(0)
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("position", (start + place + 1).cast("long")).drop("_place")

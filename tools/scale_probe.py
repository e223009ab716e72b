"""Scaling probe: the all-months report over sf0.1 `conversations` replicated k times (new conversation ids).

Usage: python tools/scale_probe.py [k ...]   (writes the replicated table once per k under a fresh /tmp folder)
Prints one line per k: messages, seconds (report computed in full with the noop sink).
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from chatlens.plans.report import Analysis  # noqa: E402
from chatlens.session import local_session  # noqa: E402
from chatlens.plans.bridge import bridge_messages  # noqa: E402


def main():
    ks = [int(k) for k in sys.argv[1:]] or [1, 10, 40]
    spark = local_session(8)
    src = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    scratch = tempfile.mkdtemp(prefix="chatlens-scale-")
    # warm-up
    Analysis(bridge_messages(src)).report().write.format("noop").mode("overwrite").save()
    for k in ks:
        path = os.path.join(scratch, f"conv_x{k}")
        (src.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("conv_id", F.col("conv_id") + F.col("copy") * F.lit(10_000_000))
            .drop("copy").write.parquet(path))
        conv = spark.read.parquet(path)
        n = conv.count()
        t = time.perf_counter()
        Analysis(bridge_messages(conv)).report().write.format("noop").mode("overwrite").save()
        print(f"x{k}: {n} messages, report_all_months {time.perf_counter() - t:.2f} s", flush=True)


if __name__ == "__main__":
    main()

"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, none
collected to the driver). Every headline query first runs once, untimed, on the
small data set, so JVM start-up, class loading and code generation are not
charged to whichever query happens to come first; then each is timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatlens.plans.registry import QUERIES  # noqa: E402
from chatlens.session import local_session  # noqa: E402

HEADLINE = [
    "department_report",
    "report_all_months",
    "department_metrics",
    "conversation_stats",
    "overview",
    "prompt_quality",
    "prompt_topic",
    "document_topic",
    "document_purpose",
    "document_quality",
    "word_count_documents",
    "ingest_mapping_roundtrip",
    "ingest_list_roundtrip",
    "transcript",
    "prompt_clusters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="chatlens-bench",
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    # The given tables hold one row group each; tagging would run in one task.
    spark.conf.set("spark.chatlens.text.partitions", cpus if cpus.isdigit() else "8")
    # Warm-up data: sf0.01 has enough prompts for the clustering path to run too.
    base = os.path.dirname(sf_dir.rstrip("/"))
    warm = next((os.path.join(base, w) for w in ("sf0.01", "sf0.001")
                 if os.path.isdir(os.path.join(base, w))
                 and os.path.abspath(os.path.join(base, w)) != os.path.abspath(sf_dir)), "")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()

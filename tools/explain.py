"""Print the executed (final adaptive) plan of registered queries.

Usage: python tools/explain.py [sf_dir] query [query ...]
Runs each query once with the noop sink, then prints ``explain("formatted")`` of the finished plan, so AQE's
final choices (broadcasts, coalesced partitions, reused exchanges) are visible.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatlens.plans.registry import QUERIES  # noqa: E402
from chatlens.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    for name in args or ["department_report"]:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"===== {name} =====")
        df.explain("formatted")


if __name__ == "__main__":
    main()

"""Monthly analysis as one Spark job (the whole page flow, without the page).

    python -m chatlens.job --exports 'exports/*.json' --year 2024 --month 2 --out reports/2024-02 \\
        [--map map.csv] [--staff staff.json] [--rules rules.json] [--cluster] [--format csv|parquet|json]

On a cluster, give spark-submit a two-line driver script (``from chatlens.job import main; main()``) and ship
the package with ``--py-files``; the arguments are the same.

Writes under ``--out``: ``report`` (the department report, captions with ``--captions``), ``kpi_table``,
``overview``, ``by_department``, ``by_department_topic``, ``rejected_files``, and with ``--cluster``
``prompts`` (prompt list with cluster labels). Without spark-submit the session defaults to ``local[*]``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.rules import RuleSet, default_topic_rules
from .operators import views
from .operators.cluster import cluster_prompts
from .operators.override import load_department_map
from .plans.report import Analysis
from .sinks import write_report, write_table
from .sources.exports import read_exports


def parse_args(argv=None):
    p = argparse.ArgumentParser(prog="chatlens.job", description=__doc__.split("\n\n")[0])
    p.add_argument("--exports", nargs="+", required=True, help="export files or globs (one account per file)")
    p.add_argument("--year", type=int, required=True)
    p.add_argument("--month", type=int, required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--map", help="CSV with account, department columns")
    p.add_argument("--staff", help="JSON object department -> staff count")
    p.add_argument("--rules", help="JSON file: topic -> keyword list (invalid JSON: default rules)")
    p.add_argument("--cluster", action="store_true", help="cluster prompts (TF-IDF + k-means)")
    p.add_argument("--format", default="csv", choices=["csv", "parquet", "json"])
    p.add_argument("--captions", action="store_true", help="original column captions in the report")
    p.add_argument("--on-error", default="file", choices=["file", "record"])
    return p.parse_args(argv)


def _text(spark: SparkSession, path: str) -> str:
    """One small settings file, read where the exports are: by Spark."""
    return spark.read.text(path, wholetext=True).first()[0]


def run(spark: SparkSession, args) -> dict:
    """Run the analysis; returns notes (warnings) for the caller."""
    notes = []
    res = read_exports(spark, args.exports, on_error=args.on_error)
    dept_map, err = load_department_map(spark, args.map)
    if err:
        notes.append(err)
    rules = default_topic_rules()
    if args.rules:
        rules = RuleSet.from_json(_text(spark, args.rules))
        notes.extend(rules.warnings)
    staff = None
    if args.staff:
        staff = {str(k): int(v) for k, v in json.loads(_text(spark, args.staff)).items()}
    a = Analysis(res.messages, args.year, args.month, topic_rules=rules, department_map=dept_map, staff=staff)
    a.materialize()  # several outputs below: parse and tag once
    out = args.out.rstrip("/")
    write_report(a.report(), f"{out}/report", fmt=args.format, captions=args.captions)
    # Department-level tables are bounded by departments x topics: one file each.
    small = {"kpi_table": a.kpi_table(), "overview": a.overview(), "by_department": a.by_department(),
             "by_department_topic": a.by_department_topic()}
    large = {"rejected_files": res.rejected}
    if args.cluster:
        large["prompts"] = views.prompt_list(cluster_prompts(a.prompts))
    for name, df in list(small.items()) + list(large.items()):
        df = df.repartition(1) if name in small else df  # after the aggregate, which stays parallel
        if args.format == "csv":
            df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        else:
            write_table(df, f"{out}/{name}", fmt=args.format)
    return {"notes": notes, "materialized_at": a.materialized_at}


def main(argv=None) -> int:
    args = parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("chatlens-job").getOrCreate()
    result = run(spark, args)
    for note in result["notes"]:
        print(f"note: {note}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Sinks for the monthly department report (SNK-1) and result tables (SNK-2)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import REPORT_CAPTION_MAP, REPORT_COLUMNS


def with_captions(report: DataFrame) -> DataFrame:
    """Rename report columns to their original captions (for spreadsheet-style exports)."""
    return report.select(*[F.col(c).alias(REPORT_CAPTION_MAP.get(c, c)) for c in report.columns])


def write_report(report: DataFrame, path: str, fmt: str = "parquet", captions: bool = False,
                 mode: str = "overwrite") -> None:
    """Write the report (11 fixed columns, department order), a folder ``period=MM-YYYY`` per month.

    The files hold all 11 columns in order. Overwriting replaces the months of this report and
    leaves others alone. The report has one row per department and month, so each month is
    a single file; CSV gets a header row (also when the month has no rows: ``period=none``).
    """
    if list(report.columns[:len(REPORT_COLUMNS)]) != REPORT_COLUMNS:
        report = report.select(*REPORT_COLUMNS)
    if fmt == "csv" and report.isEmpty():
        # No department in the period: a header-only file, as a spreadsheet export would have.
        names = [REPORT_CAPTION_MAP[c] if captions else c for c in REPORT_COLUMNS]
        header = report.sparkSession.createDataFrame([tuple(names)], ", ".join(f"c{i} string" for i in range(len(names))))
        header.coalesce(1).write.mode(mode).option("header", False).csv(f"{path}/period=none")
        return
    out = report.repartition("month_label").sortWithinPartitions("month_label", "ordinal")
    period = F.col("month_label").alias("period")
    out = out.select(*[F.col(c).alias(REPORT_CAPTION_MAP[c]) if captions else F.col(c) for c in REPORT_COLUMNS], period)
    w = out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("period")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write any result table (overview, by department, by topic, KPI table)."""
    df.write.mode(mode).format(fmt).save(path)


def publish_report(report: DataFrame, path: str, fmt: str = "parquet", captions: bool = False) -> str:
    """Publish the report's months: readers see a month's old report or its new one, never a part.

    The files go to a folder of their own (``versions/<id>``) first. Then one small file per month
    under ``manifest`` is replaced in one step; it names the version and what its files hold. A
    write that is killed before that leaves the old report in place. Returns the version.
    Months without departments are not in a report, and keep what was published.
    """
    spark = report.sparkSession
    version = uuid.uuid4().hex
    base = f"{path.rstrip('/')}/versions/{version}"
    write_report(report, base, fmt, captions)
    fs, at = _files(spark, path)
    written_months = sorted(f.getPath().getName().split("=", 1)[1] for f in fs.globStatus(at(f"{base}/period=*")) or [])
    fs.mkdirs(at(f"{path}/manifest"))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    types = {f.name: f.dataType.simpleString() for f in report.schema.fields}
    for month in written_months:
        if month == "none":
            continue
        said = {"version": version, "format": fmt, "captions": captions, "types": [types[c] for c in REPORT_COLUMNS]}
        fresh = at(f"{path}/manifest/.{month}-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        context.rename(fresh, at(f"{path}/manifest/{month}.json"), how)
    return version


def published_months(spark: SparkSession, path: str) -> dict[str, dict]:
    """Month label -> its manifest; a file per month."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/manifest")) or not fs.globStatus(at(f"{path}/manifest/*.json")):
        return {}
    rows = spark.read.text(f"{path}/manifest/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value").collect()
    return {r["f"].removesuffix(".json"): json.loads(r["value"]) for r in rows}


def read_published(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The published report of all months, or of those named ('MM-YYYY'): the 11 columns under their own names
    and ``position``, a row's place in its month's file."""
    found = {m: x for m, x in published_months(spark, path).items() if months is None or m in months}
    parts = []
    for month, x in sorted(found.items()):
        names = [REPORT_CAPTION_MAP[c] if x["captions"] else c for c in REPORT_COLUMNS]
        reader = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in zip(names, x["types"], strict=True)))
        folder = f"{path}/versions/{x['version']}/period={month}"
        if x["format"] == "csv":  # a header that says otherwise is an error
            reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True)
        df = reader.format(x["format"]).load(folder)
        parts.append(df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, REPORT_COLUMNS, strict=True)],
                               (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("position")))
    if not parts:
        raise FileNotFoundError(f"nothing published under {path}" + (f" for {months}" if months else ""))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _files(spark: SparkSession, path: str):
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at

"""Dimensions: account -> department map, staff counts (SRC-12, SRC-13, JOIN-1..3).

The joins carry no hint: adaptive execution broadcasts a side by its measured bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the reference's CSV reader takes for a missing value. Fixed values.
CSV_NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_department_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; names lower-cased (not trimmed); needs ``account`` and ``department``.

    All values are read as strings so account keys always compare as text; null words
    are missing values; quoted fields may hold doubled quotes and line breaks. Raises ``ValueError`` when the header lacks a required column.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    lowered = [c.lower() for c in raw.columns]
    if not {"account", "department"}.issubset(set(lowered)):
        raise ValueError("department map needs the columns: account, department")
    df = raw.toDF(*lowered)
    value = lambda c: F.when(~F.col(c).isin(CSV_NULL_WORDS), F.col(c)).alias(c)
    return df.select(value("account"), value("department"))


def load_department_map(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, str | None]:
    """Tolerant map loading: ``(map, None)`` or ``(None, error)``; on error departments stay as they are."""
    if path is None:
        return None, None
    try:
        df = read_department_map(spark, path)
        df.schema  # noqa: B018 - resolve now so a bad file fails here, not inside the report
        return df, None
    except Exception as exc:  # unreadable file, wrong header, ...
        return None, f"department map not used: {exc}"


def apply_department_map(messages: DataFrame, dept_map: DataFrame, duplicates: str = "multiply") -> DataFrame:
    """Left join on account; a non-null mapped department overrides the original (JOIN-1, JOIN-2).

    ``duplicates='multiply'`` keeps the join semantics (an account listed twice
    duplicates its messages); ``'error'`` refuses such a map; ``'first'`` keeps
    one row per account (smallest department).
    """
    m = dept_map.select(F.col("account").cast("string").alias("account"),
                        F.col("department").cast("string").alias("department_override"))
    if duplicates == "error":
        dup = m.groupBy("account").count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("department map lists an account more than once")
    elif duplicates == "first":
        m = m.groupBy("account").agg(F.min("department_override").alias("department_override"))
    elif duplicates != "multiply":
        raise ValueError("duplicates must be 'multiply', 'error' or 'first'")
    joined = messages.join(m, on="account", how="left")
    cols = [F.coalesce(F.col("department_override"), F.col("department")).alias("department") if c == "department"
            else F.col(c) for c in messages.columns]
    return joined.select(*cols)


def staff_table(spark: SparkSession, staff: dict[str, int] | DataFrame | None) -> DataFrame | None:
    """Staff counts per department as a DataFrame (SRC-13); ``None`` means 1 everywhere."""
    if staff is None or isinstance(staff, DataFrame):
        return staff
    rows = [(str(k), int(v)) for k, v in staff.items()]
    return spark.createDataFrame(rows, "department string, staff long")


def with_staff(df: DataFrame, staff: DataFrame | None) -> DataFrame:
    """Attach ``staff`` by department with default 1 (JOIN-3); a department listed twice counts once, with
    its largest number."""
    if staff is None:
        return df.withColumn("staff", F.lit(1).cast("long"))
    s = staff.select(F.col("department").cast("string"), F.col("staff").cast("long").alias("_staff")).groupBy(
        "department").agg(F.max("_staff").alias("_staff"))
    return (df.join(s, on="department", how="left")
            .withColumn("staff", F.coalesce(F.col("_staff"), F.lit(1).cast("long"))).drop("_staff"))

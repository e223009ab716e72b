"""KPI ladder and per-head score (SCL-5/6), department map and staff joins (SRC-12/13, JOIN-1..3)."""

import os

import pytest
from pyspark.sql import functions as F

from chatlens.functions.fixed_values import KPI_LADDER
from chatlens.functions.kpi import kpi_ladder_sql, per_head_score
from chatlens.operators.override import apply_department_map, read_department_map, staff_table, with_staff

COLS = "prompts long, active_days long, unique_topics long, avg_prompts_per_conversation double, avg_words_per_prompt double"


def rate(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    rating, raw = kpi_ladder_sql()
    return [tuple(x) for x in df.select(F.expr(rating), F.expr(raw)).collect()]


def test_each_band_at_threshold_and_below(spark):
    rows, want = [], []
    for label, score, p, d, t, m, w, _alt in KPI_LADDER[:5]:
        at = (p, d or 0, t or 0, m, w)
        rows.append(at)
        want.append((label, score))
        for i, v in enumerate(at):  # one metric just below its threshold drops to a lower band
            if [p, d, t, m, w][i] is None:
                continue
            below = list(at)
            below[i] = v - 1 if isinstance(v, int) else v - 0.01
            rows.append(tuple(below))
            want.append(None)
    got = rate(spark, rows)
    ranks = {label: i for i, (label, *_rest) in enumerate(KPI_LADDER)}
    j = 0
    for k, expect in enumerate(want):
        if expect is not None:
            assert got[k] == expect
            current = ranks[expect[0]]
        else:
            assert ranks.get(got[k][0], 99) > current, (rows[k], got[k])


def test_hand_checked_points(spark):
    rows = [(200, 25, 17, 10.0, 40.0), (199, 25, 17, 10.0, 40.0), (100, 14, 10, 5.0, 25.0), (100, 12, 9, 4.0, 20.0),
            (99, 5, 1, 3.0, 15.0), (100, 0, 0, 3.0, 15.0), (99, 4, 1, 3.0, 15.0), (1, 0, 0, 0.0, 0.0),
            (0, 0, 0, 0.0, 0.0), (0, 5, 0, 3.0, 15.0)]
    assert rate(spark, rows) == [("Xuất sắc", 100), ("Rất tốt", 95), ("Tốt", 85), ("Khá", 80), ("Trung bình", 50),
                                 ("Trung bình", 50), ("Thấp", 25), ("Thấp", 25), ("Không sử dụng", 0),
                                 ("Trung bình", 50)]


def test_per_head_half_even(spark):
    df = spark.createDataFrame([(85, 2), (95, 2), (25, 2), (50, 4), (100, 3), (90, 0), (25, 1)], "raw long, staff long")
    got = [r.s for r in df.select(per_head_score(F.col("raw"), F.col("staff")).alias("s")).collect()]
    assert got == [42, 48, 12, 12, 33, 0, 25]


def messages(spark):
    return spark.createDataFrame(
        [("acc1", "acc1", "m1"), ("acc2", "acc2", "m2"), ("acc3", "acc3", "m3")],
        "account string, department string, message_id string")


def test_department_map_override(spark):
    m = spark.createDataFrame([("acc1", "Finance"), ("acc2", None), ("zzz", "Other")], "account string, department string")
    got = sorted((r.account, r.department) for r in apply_department_map(messages(spark), m).collect())
    assert got == [("acc1", "Finance"), ("acc2", "acc2"), ("acc3", "acc3")]


def test_department_map_duplicates(spark):
    m = spark.createDataFrame([("acc1", "A"), ("acc1", "B")], "account string, department string")
    assert apply_department_map(messages(spark), m).count() == 4  # the join multiplies, as a left join does
    with pytest.raises(ValueError):
        apply_department_map(messages(spark), m, duplicates="error")
    assert apply_department_map(messages(spark), m, duplicates="first").count() == 3


def test_read_department_map(spark, scratch_dir):
    good = os.path.join(scratch_dir, "map.csv")
    with open(good, "w", encoding="utf-8") as fh:
        fh.write("Account,DEPARTMENT,extra\n001,Kế toán,x\nacc2,,y\n")
    df = read_department_map(spark, good)
    assert sorted((r.account, r.department) for r in df.collect()) == [("001", "Kế toán"), ("acc2", None)]
    bad = os.path.join(scratch_dir, "bad.csv")
    with open(bad, "w", encoding="utf-8") as fh:
        fh.write("acct,dept\na,b\n")
    with pytest.raises(ValueError):
        read_department_map(spark, bad)


def test_staff_default_one(spark):
    df = spark.createDataFrame([("a",), ("b",)], "department string")
    got = sorted((r.department, r.staff) for r in with_staff(df, staff_table(spark, {"b": 3})).collect())
    assert got == [("a", 1), ("b", 3)]
    assert [r.staff for r in with_staff(df, None).collect()] == [1, 1]
    twice = spark.createDataFrame([("b", 2), ("b", 3)], "department string, staff long")
    assert sorted((r.department, r.staff) for r in with_staff(df, twice).collect()) == [("a", 1), ("b", 3)]


def test_load_department_map_keeps_departments_on_error(spark, scratch_dir):
    from chatlens.operators.override import load_department_map
    bad = os.path.join(scratch_dir, "bad.csv")
    with open(bad, "w", encoding="utf-8") as fh:
        fh.write("who,where\na,b\n")
    df, err = load_department_map(spark, bad)
    assert df is None and "department map" in err
    df, err = load_department_map(spark, os.path.join(scratch_dir, "missing.csv"))
    assert df is None and err
    assert load_department_map(spark, None) == (None, None)


def test_active_days_bitset_edges(spark):
    from datetime import datetime
    from chatlens.plans.report import Analysis
    rows = [  # account, conversation, message, role, local time
        ("d1", "c1", "m1", "user", datetime(2024, 1, 31, 23, 59)),
        ("d1", "c1", "m2", "assistant", datetime(2024, 2, 1, 0, 0)),   # same conversation, next month
        ("d1", "c1", "m3", "user", datetime(2024, 1, 1, 8, 0)),
        ("d1", "c2", "m4", "user", datetime(2024, 1, 31, 9, 0)),
        ("d2", "c3", "m5", "user", datetime(2024, 12, 31, 9, 0)),
    ]
    df = spark.createDataFrame(rows, "account string, conversation_id string, message_id string, role string, "
                                     "create_time_local timestamp_ntz")
    df = (df.withColumn("department", F.col("account")).withColumn("conversation_title", F.lit("t"))
          .withColumn("author", F.lit(None).cast("string")).withColumn("text", F.lit("viết"))
          .withColumn("create_time_utc", F.col("create_time_local"))
          .withColumn("date", F.to_date("create_time_local"))
          .withColumn("month", F.date_format("create_time_local", "yyyy-MM")))
    a = Analysis(df)
    conv = {(r.month, r.conversation_id): r.active_days for r in a.conv_stats.collect()}
    assert conv == {("2024-01", "c1"): 2, ("2024-02", "c1"): 1, ("2024-01", "c2"): 1, ("2024-12", "c3"): 1}
    dept = {(r.month, r.department): r.active_days for r in a.department_metrics().collect()}
    assert dept == {("2024-01", "d1"): 2, ("2024-02", "d1"): 1, ("2024-12", "d2"): 1}


def test_percent_text_matches_python_format(spark):
    from chatlens.operators.distribution import percent_text
    pairs = [(n, t) for t in range(1, 201) for n in range(1, t + 1)]
    df = spark.createDataFrame(pairs, "n long, t long")
    got = {(r.n, r.t): r.p for r in df.select("n", "t", percent_text(F.col("n"), F.col("t")).alias("p")).collect()}
    bad = [(n, t) for n, t in pairs if got[(n, t)] != f"{n / t:.0%}"]
    assert not bad, bad[:5]


def test_report_same_with_ansi_off(spark):
    from chatlens.plans.registry import QUERIES
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        results = []
        for ansi in ["true", "false"]:
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            results.append(sorted(tuple(r) for r in QUERIES["department_report"](spark, "/root/testdata/sf0.01").collect()))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert results[0] == results[1]

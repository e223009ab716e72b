"""Data kept whole around the main path: landing, streaming, sinks, CSV, settings, plans."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from chatlens.operators.cluster import cluster_prompts, prompt_terms, vocabulary
from chatlens.operators.override import read_department_map
from chatlens.operators.position import with_position
from chatlens.plans.bridge import load_messages
from chatlens.plans.registry import QUERIES, shaped_export_docs
from chatlens.plans.report import Analysis, department_metrics
from chatlens.schema import MESSAGE_COLUMNS, REPORT_CAPTION_MAP, REPORT_COLUMNS
from chatlens.session import checkpoint_dir
from chatlens.sinks import write_report
from chatlens.sources.ranges import cut_exports
from chatlens.sources.exports import flatten_exports, land_messages, read_exports, read_landed
from chatlens.streaming.landing import start_landing

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def months(df):
    return {r.month: r["count"] for r in df.groupBy("month").count().collect()}


def test_landing_one_month_again_keeps_the_others(spark, scratch_dir):
    msgs, path = load_messages(spark, SMALL), os.path.join(scratch_dir, "land")
    land_messages(msgs, path)
    before = months(read_landed(spark, path))
    assert len(before) == 3
    land_messages(msgs.where("month = '2024-02'"), path)
    assert months(read_landed(spark, path)) == before


def test_landing_of_nothing_can_be_read(spark, scratch_dir):
    path = os.path.join(scratch_dir, "none")
    land_messages(load_messages(spark, SMALL).where("false"), path)
    assert read_landed(spark, path).columns == MESSAGE_COLUMNS and read_landed(spark, path).count() == 0


def test_landing_file_count_follows_the_bytes(spark, scratch_dir):
    path, key = os.path.join(scratch_dir, "few"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        land_messages(load_messages(spark, SF), path)
    finally:
        spark.conf.set(key, before)
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 6  # three months; a month is in one partition unless it is large


def export(folder, name, text="viết báo cáo", conv="c1", message="m1"):
    os.makedirs(folder, exist_ok=True)
    body = [{"id": conv, "title": "T", "mapping": {"n": {"message": {"id": message, "author": {"role": "user"}, "content": {"parts": [text]}, "create_time": 1706720400}}}}]
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        json.dump(body, fh, ensure_ascii=False)


def land(spark, src, target, **kw):
    start_landing(spark, src, target, **kw).awaitTermination(120)
    return sorted(r.account for r in read_landed(spark, target).select("account").collect())


def test_streams_of_several_sources_and_targets(spark, scratch_dir):
    a, b, t1, t2 = (os.path.join(scratch_dir, x) for x in ("a", "b", "t1", "t2"))
    export(a, "A.json")
    export(b, "B.json")
    assert land(spark, a, t1) == ["A"] and land(spark, a, t2) == ["A"]
    assert land(spark, b, t1) == ["A", "B"]
    export(a, "A2.json")
    assert land(spark, a, t1) == ["A", "A2", "B"] and land(spark, a, t1) == ["A", "A2", "B"]


def test_stream_refuses_a_target_without_its_progress(spark, scratch_dir):
    src, target = os.path.join(scratch_dir, "s"), os.path.join(scratch_dir, "t")
    export(src, "A.json")
    assert land(spark, src, target, checkpoint=os.path.join(scratch_dir, "c1")) == ["A"]
    with pytest.raises(RuntimeError, match="progress"):
        start_landing(spark, src, target, checkpoint=os.path.join(scratch_dir, "c2"))


def test_invalid_utf8_is_rejected(spark, scratch_dir):
    src = os.path.join(scratch_dir, "u")
    export(src, "Good.json")
    with open(os.path.join(src, "Latin.json"), "wb") as fh:
        fh.write('[{"id": "c", "title": "café", "messages": []}]'.encode("latin-1"))
    res = read_exports(spark, os.path.join(src, "*.json"))
    assert [(r.file, r.reason) for r in res.rejected.collect()] == [("Latin.json", "not valid UTF-8")]
    assert [r.account for r in res.messages.collect()] == ["Good"]


@pytest.mark.parametrize("on_error", ["file", "record"])
def test_files_cut_anywhere_equal_whole_documents_in_every_shape(spark, scratch_dir, on_error):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    docs = shaped_export_docs(spark.read.parquet(SF + "/conversations.parquet")).where("file is not null")
    contents = ['{"a": 1}', "{hello", "{", r"{\\frac{1}{2}}", '{"parts": ["no"]}', '["x"]', "", "5", {"parts": ["{a", "", None, "b"]}, {"parts": []}, {"parts": [True, "t", 2.50, {"z": 1, "a": "é"}, ["q"], "u"]},
                {"parts": "no list", "text": "{t"}, {"text": 5}, {"text": ""}, {}, None, 7, ["p"], True]
    message = lambda k, c: {"id": k, "author": {"role": "user", "name": "N"}, "content": c, "create_time": 1706720400.25, "other": [1]}
    good = {"id": "c", "title": "T", "messages": [message(k, c) for k, c in enumerate(contents)] + [{"x": 1}, {}, {"role": "r", "timestamp": "5", "author": None}]}
    tree = {"id": 1.50, "conversation_title": 3, "mapping": {f"n{k}": {"message": message("", c)} for k, c in enumerate(contents)} | {"e": {}, "v": {"message": None}, "w": {"message": {}}}}
    bad = [{"id": "b1", "messages": [7]}, {"id": "b2", "messages": ["{}"]}, {"id": "b3", "mapping": {"k": 5}}, {"id": "b4", "mapping": {"k": {"message": "m"}}},
           {"id": "b5", "mapping": {"k": {"message": {"author": "a"}}}}, {"id": "b6", "messages": [{"author": [1]}]}, {"id": "b7", "messages": [None]}]
    fine = [{"id": "f", "mapping": {"k": {"message": {"author": ""}}}}, {"id": "g", "messages": "no"}, {"id": "h", "mapping": 5, "messages": [message(1, "m")]}]
    roots = [[good, tree], {"conversations": [good, tree]}, good, {"conversations": 5} | tree, {"conversations": [good, 5], "messages": [message(9, "root")]}, [[]], [5], 5, [], fine]
    roots += [[good, b, tree] for b in bad] + [[good, "text"], [good, None], {"conversations": [good, None, tree]}]
    texts = [json.dumps(r, ensure_ascii=k % 2 == 0) for k, r in enumerate(roots)] + ["no", "{", "", "\ufeff" + json.dumps([good]), json.dumps([good]) + " tail", r'[{"id": "s", "messages": [{"content": "\ud800 x"}]}]']
    docs = docs.select("file", "json").union(spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "file string, json string"))
    docs = docs.where("json <> '' and (file like 't%' or file like '%-1')")  # Spark does not list empty files
    rows = docs.collect()
    for r in rows:
        with open(os.path.join(scratch_dir, f"{r.file}.json"), "w", encoding="utf-8") as fh:
            fh.write(r.json)
    usual = flatten_exports(docs, account_col="file", on_error=on_error)
    want = sorted(map(str, usual.messages.collect())), sorted((r.file, r.reason) for r in usual.rejected.collect())
    assert len(want[0]) > 150 and len(want[1]) > 10
    assert any("'{\"a\": 1}'" in x for x in want[0]) and any("text='{hello'" in x for x in want[0])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "997b"):  # one range for each file, or a great many
            for k in before:
                spark.conf.set(k, size)
            large = read_exports(spark, os.path.join(scratch_dir, "*.json"), on_error=on_error)
            assert sorted(map(str, large.messages.collect())) == want[0], size
            assert sorted((r.file.removesuffix(".json"), r.reason) for r in large.rejected.collect()) == want[1], size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_large_file_is_many_tasks(spark, scratch_dir):
    path = os.path.join(scratch_dir, "Large file.json")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('{"version": "{[\\"", "conversations": [')
        for k in range(4000):
            fh.write(("," if k else "") + json.dumps({"id": f"c{k}", "title": "x", "messages": [{"id": f"{k}-{i}", "role": "user", "content": "braces } ] { [ \" \\" * 20, "create_time": 1706720400} for i in range(3)]}))
        fh.write("]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert os.path.getsize(path) > 4 << 20
        cut = cut_exports(spark, [path])
        assert cut.rdd.getNumPartitions() >= 4
        assert cut.select(F.max(F.octet_length("json"))).first()[0] < 4000
        res = read_exports(spark, path)
        assert res.rejected.count() == 0
        got = res.messages.groupBy("account").agg(F.count("*").alias("n"), F.countDistinct("message_id").alias("m"), F.countDistinct("conversation_id").alias("c")).collect()
        assert [tuple(r) for r in got] == [("Large file", 12000, 12000, 4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_text_above_the_parsers_usual_string_limit_is_kept(spark):
    docs = spark.sql("""select 'f' file, concat('[{"id":"c","messages":[{"content":"', repeat('0123456789', 2100000), '"}]}]') json""")
    res = flatten_exports(docs, account_col="file")
    assert [r.n for r in res.messages.selectExpr("length(text) n").collect()] == [21_000_000] and res.rejected.count() == 0


def test_a_value_that_cannot_be_held_rejects_its_file(spark):
    docs = spark.sql("""select 'f' file, concat('[{"id":"c","messages":[{"content":"', repeat('0123456789', 14000000), '"}]}]') json""")
    res = flatten_exports(docs, account_col="file")
    assert res.messages.count() == 0 and [r.reason for r in res.rejected.collect()] == ["a value above 128 MiB"]


def test_checkpoint_folder_must_be_named():
    class Bare:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Bare)


def test_materialized_prompts_do_not_parse_again(spark, scratch_dir):
    src = os.path.join(scratch_dir, "m")
    export(src, "A.json")
    a = Analysis(read_exports(spark, os.path.join(src, "*.json")).messages, 2024, 2).materialize(os.path.join(scratch_dir, "kept"))
    for df in (a.prompts, a.month_df, a.report()):
        assert "from_json" not in df._jdf.queryExecution().toString()
    assert [r.text for r in a.prompts.collect()] == ["viết báo cáo"]


def test_building_an_analysis_starts_no_job(spark):
    msgs = load_messages(spark, SMALL).repartition(3)
    dept = msgs.groupBy("account").agg(F.max("department").alias("department"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        Analysis(msgs, 2024, 2, department_map=dept, staff={"dept_1": 2}).report()
        time.sleep(0.3)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_year_without_month_is_an_error(spark):
    for kw in ({"year": 2024}, {"month": 2}):
        with pytest.raises(ValueError):
            Analysis(load_messages(spark, SMALL), **kw)


def test_kpi_bands_reach_every_label(spark):
    got = {(r.rating, r.raw_score) for r in QUERIES["kpi_bands"](spark, SF).select("rating", "raw_score").distinct().collect()}
    assert got == {("Xuất sắc", 100), ("Rất tốt", 95), ("Tốt+", 90), ("Tốt", 85), ("Khá", 80), ("Trung bình", 50), ("Thấp", 25), ("Không sử dụng", 0)}


def test_share_strings_are_linear_in_the_labels(spark):
    stats = Analysis(load_messages(spark, SMALL)).conv_stats.withColumn("department", F.lit("d")).withColumn("month", F.lit("2024-01"))

    def seconds(labels):
        prompts = spark.range(20_000).select(F.lit("2024-01").alias("month"), F.lit("d").alias("department"), F.concat(F.lit("t"), F.col("id") % labels).alias("topic"),
                                             F.concat(F.lit("p"), F.col("id") % 9).alias("purpose"), F.lit(1).cast("long").alias("word_count"))
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            r = department_metrics(stats, prompts).collect()
            best = min(best, time.perf_counter() - t)
        assert r[0].unique_topics == labels and len(r[0].topic_distribution.split("\n")) == labels
        return best
    few = seconds(17)
    assert seconds(2000) <= 2 * few + 0.5


def test_department_map_like_the_references_reader(spark, scratch_dir):
    path = os.path.join(scratch_dir, "map.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('Account,Department\na,NA\nb,N/A\nc,"Sales ""A"""\nd,"two\nlines"\ne,null\nf,Nan\n')
    got = {r.account: r.department for r in read_department_map(spark, path).collect()}
    assert got == {"a": None, "b": None, "c": 'Sales "A"', "d": "two\nlines", "e": None, "f": "Nan"}


def test_report_files_hold_eleven_columns_and_months_stay(spark, scratch_dir):
    import csv
    out, msgs = os.path.join(scratch_dir, "rep"), load_messages(spark, SF)
    for m in (1, 2, 1):
        write_report(Analysis(msgs, 2024, m).report(), out, fmt="csv", captions=True)
    parts = sorted(os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.endswith(".csv"))
    assert len(parts) == 2
    for p, label in zip(parts, ("01-2024", "02-2024"), strict=True):
        with open(p, encoding="utf-8", newline="") as fh:
            rows = list(csv.reader(fh))
        assert rows[0] == [REPORT_CAPTION_MAP[c] for c in REPORT_COLUMNS] and len(rows[0]) == 11
        assert {r[2] for r in rows[1:]} == {label} and [r[1] for r in rows[1:]] == [str(k) for k in range(1, len(rows))]
        assert all("\n" in r[7] or r[7].startswith("+ ") for r in rows[1:])


def test_positions_are_the_global_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 13).alias("k")).repartition(5)
    got = with_position(df, [F.desc("k"), F.asc("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert with_position(df.where("false"), [F.asc("id")]).count() == 0


def test_clusters_do_not_depend_on_the_input_partitions(spark):
    a = Analysis(load_messages(spark, SF), 2024, 2).prompts
    got = [sorted((r.message_id, r.cluster) for r in cluster_prompts(a.repartition(n), n_init=1).collect()) for n in (1, 5)]
    assert got[0] == got[1]


def test_tokens_and_vocabulary(spark):
    import re
    texts = ["Xin chào_1 a b2, ½½ x́y été", "chào chào", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in prompt_terms(df).collect():
        uni = re.findall(r"(?u)\b\w\w+\b", (r.text or "").lower())
        assert r.terms == uni + [f"{x} {y}" for x, y in zip(uni, uni[1:], strict=False)]
    got = [(r.term, r.total, r.df) for r in vocabulary(prompt_terms(df), 2).orderBy(F.desc("total"), "term").collect()]
    assert got[0][0] == "chào" and got[0][1:] == (2, 1) and len(got) == 2

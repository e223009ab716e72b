"""Registered queries that write files and read them back: exports, department map, published report.

They live under ``spark.checkpoint.dir``. File names are given by renaming what Spark wrote, a file
at a time through Hadoop's file systems, so any storage Spark can write will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import sql_string
from ..operators.override import load_department_map
from ..schema import REPORT_COLUMNS
from ..session import checkpoint_dir
from ..sinks import publish_report, read_published
from ..sources.exports import read_exports
from .bridge import DEPARTMENTS, bridge_raw, load_messages, read_table
from .report import Analysis

#: Accounts by number, with signs that paths and URLs treat specially; a file is named after its account.
ACCOUNT_NAMES = ["Kế toán", "R+D", "50% Büro", "a.b c", "Ünal & Söhne (2)"]
#: Turns of one exported conversation object at most: a longer conversation is exported in parts.
TURNS = 64
#: What the department map says of an account, by its number.
MAPPED = ['Sales "A", Nord', "two\nlines", "N/A", "", "Kế hoạch"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/chatlens-{name}-{uuid.uuid4().hex}"


def conversation_objects(conversations: DataFrame) -> DataFrame:
    """(number, conversation_id, part, json): conversations as export objects of up to ``TURNS`` turns each, by
    turns the map form and the list form."""
    rows = bridge_raw(conversations.select("*")).select("*").withColumn("number", F.substring_index("account", "_", -1).cast("int"))
    rows = rows.withColumn("turn", F.substring_index("message_id", "-", -1).cast("long")).withColumn("part", F.floor(F.col("turn") / TURNS))
    message = F.struct(F.col("turn"), F.col("message_id").alias("id"), F.col("role"), F.col("author"), F.col("text"), F.col("epoch_seconds"))
    held = rows.groupBy("number", "conversation_id", "conversation_title", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    node = lambda x, k: F.struct(F.concat(x["id"], F.lit("/"), k.cast("string")).alias("key"), F.struct(
        x["id"].alias("id"), F.struct(
            x["id"].alias("id"), F.struct(x["role"].alias("role"), x["author"].alias("name")).alias("author"),
            F.struct(F.lit("text").alias("content_type"), F.array(x["text"]).alias("parts")).alias("content"),
            x["epoch_seconds"].alias("create_time")).alias("message")).alias("value"))
    item = lambda x: F.struct(x["id"].alias("id"), x["role"].alias("role"), x["text"].alias("content"),
                              x["epoch_seconds"].cast("long").cast("string").alias("timestamp"))
    by_map = F.to_json(F.struct(F.col("conversation_id").alias("id"), F.col("conversation_title").alias("title"),
                                F.map_from_entries(F.transform("m", node)).alias("mapping")))
    by_list = F.to_json(F.struct("conversation_id", "conversation_title", F.transform("m", item).alias("messages")))
    odd = F.substring("conversation_id", 2, 20).cast("long") % 2 == 1
    return held.select("number", "conversation_id", "part", F.when(odd, by_list).otherwise(by_map).alias("json"))


def write_export_files(objects: DataFrame, folder: str, files: int) -> int:
    """One JSON list per account and file, ``<folder>/<file>/<account>.json``; the number of files written."""
    spark = objects.sparkSession
    rows = objects.select(F.pmod(F.xxhash64("conversation_id", "part"), F.lit(files)).cast("int").alias("file"), "number",
                          F.lit(1).alias("place"), F.concat(F.lit(","), "json").alias("value"))
    # Each file begins with a conversation that has no messages, so that the others can all follow a comma.
    ends = spark.range(files * DEPARTMENTS).select((F.col("id") % files).cast("int").alias("file"), F.floor(F.col("id") / files).cast("int").alias("number"), F.explode(
        F.array(F.struct(F.lit(0).alias("place"), F.lit('[{"id":"none"}').alias("value")), F.struct(F.lit(2).alias("place"), F.lit("]").alias("value")))).alias("e")).select(
        "file", "number", "e.*")
    raw = f"{folder}-raw"
    rows.unionByName(ends).repartition(files * DEPARTMENTS, "file", "number").sortWithinPartitions("file", "number", "place").select(
        "value", "file", "number").write.partitionBy("file", "number").text(raw)
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for f in fs.globStatus(path(f"{raw}/file=*/number=*/part-*")):
        number, file = f.getPath().getParent(), f.getPath().getParent().getParent()
        target = path(f"{folder}/{file.getName().split('=')[1]}")
        fs.mkdirs(target)
        name = ACCOUNT_NAMES[int(number.getName().split("=")[1])]
        if not fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, f"{name}.json")):
            raise OSError(f"cannot rename {f.getPath()}")
        n += 1
    return n


def q_export_files(spark, sf_dir):
    """All conversations as export files, a file per account and folder, read back by the export reader."""
    from .registry import compare_ready

    folder = _folder(spark, "files")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // DEPARTMENTS)
    write_export_files(conversation_objects(read_table(spark, sf_dir, "conversations")), folder, files)
    return compare_ready(read_exports(spark, f"{folder}/*/*.json").messages)


def _written_map(spark: SparkSession, sf_dir: str, header: str) -> str:
    """A CSV that maps the accounts of ``conversations``: doubled quotes, a line break, null words, header in mixed case."""
    said = F.get(F.array(*[F.lit(x) for x in MAPPED]), F.substring_index("account", "_", -1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    accounts = load_messages(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n"))  # a row per account
    lines = accounts.select(F.lit(1).alias("place"), F.concat("account", F.lit(","), quoted(said)).alias("value"))
    lines = lines.union(spark.sql(f"select 0, {sql_string(header)}"))
    path = _folder(spark, "map")
    lines.repartition(1).sortWithinPartitions("place", "value").select("value").write.text(path)
    return path


def _by_mapped_department(spark, sf_dir, header):
    from .registry import REPORT_MONTH, REPORT_YEAR

    found, error = load_department_map(spark, _written_map(spark, sf_dir, header))
    a = Analysis(load_messages(spark, sf_dir), REPORT_YEAR, REPORT_MONTH, department_map=found)
    return a.by_department().drop("month").withColumn("map_used", F.lit(error is None))


def q_department_map_csv(spark, sf_dir):
    return _by_mapped_department(spark, sf_dir, "Account,DEPARTMENT")


def q_department_map_wrong_header(spark, sf_dir):
    return _by_mapped_department(spark, sf_dir, "Account,Team")


def q_report_roundtrip(spark, sf_dir):
    """The report of every month, published as CSV with captions and read back, with each row's place in its file."""
    from .registry import compare_ready

    path = _folder(spark, "published")
    publish_report(Analysis(load_messages(spark, sf_dir)).report(), path, fmt="csv", captions=True)
    got = read_published(spark, path)
    return compare_ready(got.select(*REPORT_COLUMNS, "position"))


QUERIES = {"export_files": q_export_files, "department_map_csv": q_department_map_csv,
           "department_map_wrong_header": q_department_map_wrong_header, "report_roundtrip": q_report_roundtrip}

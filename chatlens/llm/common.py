"""Helpers the operators share: scratch tables, row keys, components of a graph."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator that counts words: ASCII white space.
BLANKS = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]

DOC_ID, TEXT_HASH = "doc_id", "_th"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack the setting (tests); it gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    d = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Folders of intermediate tables this process has named, in order.
_SCRATCH: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """Where ``drop_scratch`` may begin: tables written from now on."""
    return len(_SCRATCH)


def drop_scratch(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Deletes the intermediate tables named since ``scratch_mark()``, except ``but``. For callers
    that have written the results which were read from them."""
    for path in [p for p in _SCRATCH[since:] if p not in but]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _SCRATCH.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, outlives
    executors, and fixes values that depend on how a job was dealt out."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_hash(col: str = "text") -> Column:
    """Tells rows of one doc_id apart. Rows with equal doc_id and text are one document."""
    return F.xxhash64(F.col(col))


def words(col: str | Column) -> Column:
    """Array of the words of a text; empty for null and blank texts. JVM only."""
    c = F.col(col) if isinstance(col, str) else col
    inner = F.btrim(c, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def apart(col: Column) -> Column:
    """The same long by another expression. Joined under this key, an aggregate's output
    is exchanged once more, so that Spark can split a hot key of the other side."""
    return F.bitwise_not(F.bitwise_not(col))


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of narrow rows: broadcast if it has ``most`` rows at most (some MB),
    otherwise as it is, for a shuffled join whose hot keys Spark can split."""
    return F.broadcast(df) if df.count() <= most else df


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, beside ``cols``: no name can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(k) for k, c in cols.items()])


def unpacked(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The ``columns`` of ``row``, then the results; a column named like one (case ignored)
    gives way, in its place for ``text`` and ``n_chars``."""
    low = {k.lower(): k for k in results}
    place = {c: results[low[c.lower()]] for c in columns if c.lower() in low and c.lower() in ("text", "n_chars")}
    out = [place[c].alias(c) if c in place else F.col("row").getField(c).alias(c) for c in columns if c in place or c.lower() not in low]
    return df.select(*out, *[v.alias(k) for k, v in results.items() if k.lower() not in {c.lower() for c in place}])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps: each keeps the components and shortens
    the paths, so about log(diameter) rounds end in stars. Every round is one written
    table; the driver sees two numbers of each. Nodes without an edge do not appear.
    """
    pair = lambda df: df.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs: a < b. large star: each node hands its smallest neighbour to the larger ones.
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            apart(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                                  F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return pair(out)

    now = written(pair(edges), "edges")
    seen = digest(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        now = written(star(star(now, True), False), "edges")
        last, seen = seen, digest(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def one_per_text(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, text) of ``docs``, one row of each (doc_id, text). Only repeated rows move."""
    keyed = docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), text_hash().alias(TEXT_HASH), "text")
    again = written(keyed.groupBy(DOC_ID, TEXT_HASH).count().where("count > 1").select(
        F.col(DOC_ID).alias("_id"), F.col(TEXT_HASH).alias("_h")), "again")
    if again.isEmpty():
        return keyed
    cond = keyed[DOC_ID].eqNullSafe(again["_id"]) & (keyed[TEXT_HASH] == again["_h"])
    return keyed.join(again, cond, "left_anti").unionByName(
        keyed.join(again, cond, "left_semi").dropDuplicates([DOC_ID, TEXT_HASH]))

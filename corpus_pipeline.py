"""The training-corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark
decontamination, mixing. Counts as part of ``chatlens.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm.common import drop_scratch, new_path, scratch_mark, table
from chatlens.llm.decontaminate import decontaminate
from chatlens.llm.linededup import dedup_lines
from chatlens.llm.mix import mix_texts
from chatlens.llm.simhash import keep_one
from chatlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays."""
    return dedup_lines(docs).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest doc_id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of copies and of words taken."""
    return mix_texts(docs).where(F.col("copies") > 0)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: Classifiers, suffix arrays and random rounding are not SQL; tests compare each stage with a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = scratch_mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            drop_scratch(spark, mark, but=(path,))  # what only this stage has read
    return docs

"""Incremental landing of export files (SRC-1 run as a Structured Streaming job).

New ``*.json`` exports dropped into a folder are parsed with the same
``flatten_exports`` as the batch reader and appended to the landing table
(Parquet, partitioned by ``ingest_batch`` and ``month``), plus the rejected
files to a side table. Each micro-batch writes into its own ``ingest_batch=N``
partition with overwrite semantics, so a batch replayed after a failure
replaces its own output instead of duplicating it; progress lives in the
checkpoint folder (under ``spark.checkpoint.dir`` unless given). No state is
kept between batches: every file is complete in itself.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.exports import account_from_file_name, by_month, flatten_exports


def export_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.load(source_dir)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("json"))
            .withColumn("account", account_from_file_name(F.col("file_name"))))


def _write_batch(target_dir: str, rejected_dir: str, on_error: str, key: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Two outputs per batch: keep the file texts for the batch so files are read once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            res = flatten_exports(batch, json_col="json", account_col="account", file_col="file_name",
                                  on_error=on_error)
            # A batch that runs again replaces its own folders and nothing else.
            (by_month(res.messages).write.mode("overwrite").partitionBy("month")
             .parquet(f"{target_dir}/ingest_batch={key}-{batch_id}"))
            res.rejected.write.mode("overwrite").parquet(f"{rejected_dir}/ingest_batch={key}-{batch_id}")
        finally:
            batch.unpersist()
    return write


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def start_landing(spark: SparkSession, source_dir: str, target_dir: str, rejected_dir: str | None = None,
                  checkpoint: str | None = None, available_now: bool = True, on_error: str = "file",
                  max_files_per_trigger: int | None = None):
    """Start the landing query; ``available_now`` processes what is there and stops.

    Progress and output folders belong to one pair of source and target: several sources may
    land in one target and one source in several. A target that has batches of the source
    without their progress is refused, since batch numbers would start again.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    target_dir, source_dir = target_dir.rstrip("/"), source_dir.rstrip("/")
    key = hashlib.sha256(f"{source_dir}\n{target_dir}".encode()).hexdigest()[:12]
    checkpoint = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/chatlens-landing-{key}"
    rejected_dir = rejected_dir or f"{target_dir}_rejected"
    if _exists(spark, f"{target_dir}/ingest_batch={key}-*") and not _exists(spark, checkpoint):
        raise RuntimeError(f"{target_dir} holds batches of this source, but its progress in {checkpoint} is gone: "
                           "restore the checkpoint, or land into an empty target")
    w = (export_stream(spark, source_dir, max_files_per_trigger).writeStream
         .foreachBatch(_write_batch(target_dir, rejected_dir, on_error, key))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

"""Session helpers: local session for tests/bench, checkpoint directory handling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "chatlens",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """``local[cpus]`` session with AQE on and the UI off (tests and bench only;
    on a cluster the session comes from the platform)."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.variant.allowDuplicateKeys", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; an error if the session names none.

    Intermediate tables must be readable by every executor, so no local folder is made up.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: computed once, outlives executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/chatlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

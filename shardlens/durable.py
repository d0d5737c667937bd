"""Intermediate tables kept in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may fall back on a folder of its own machine; on a
    cluster every executor must be able to read what another one wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardlens-"))
    return spark.sparkContext.getCheckpointDir()


def store(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back: cuts lineage and pins its row layout.

    The reader sees the written file sizes, so Spark plans later joins on true
    sizes, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""The shared work folder and intermediate tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; only a local master may fall back to a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back, so that a loop's plan does not grow with its rounds."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Incremental ingestion: micro-batches of observations folded into cumulative tallies, each file read once.

Every batch is appended to the observation log under its batch number, so a batch that runs again after a failure
replaces itself and counts once; tallies are a fold over the log and can be rebuilt from it at any time. A newer
reading of a witness supersedes its earlier ones: the log keeps them, the fold takes the newest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.fold import tally


def ingest(spark: SparkSession, source: str, schema: StructType | str, observe: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, file_format: str = "parquet", files_per_batch: int = 1) -> None:
    """Read what is new under the source, turn it into observations and append them to the log; ends when all is read."""

    def append(batch: DataFrame, number: int) -> None:
        observe(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    stream = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(log: DataFrame) -> DataFrame:
    """Of each witness only its newest reading counts. log(..., witness, batch)"""
    newest = F.max("batch").over(Window.partitionBy("witness"))
    return log.withColumn("newest", newest).filter("batch = newest").drop("newest")


def tallies(spark: SparkSession, log: str, supersede: bool = False) -> DataFrame:
    """Tallies over the whole log."""
    rows = spark.read.parquet(log)
    return tally(current(rows) if supersede else rows)

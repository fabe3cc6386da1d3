"""Shared plumbing: the shared work folder, written intermediate tables, bounded Arrow batches, text buffers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch on its way to Python; keeps worker memory flat when some texts are huge.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; only a local master may fall back to a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends, a lost executor loses nothing, and what
    hangs on task order (row numbers) is fixed from here on."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A prefix that no column of the table begins with, in either case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(base.lower()) for c in taken):
        base += "_"
    return base


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows unless the session already does."""
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        if int(spark.conf.get(name, str(2**31 - 1))) > value:
            spark.conf.set(name, str(value))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows; null counts as empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]

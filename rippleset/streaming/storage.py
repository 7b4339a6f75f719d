"""Folders that driver and executors share, and tables written once for each batch of a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``; without one a local session gets a temporary folder, others an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Writes one batch under its number; a batch that comes again after a failure replaces itself."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches written to a folder so far."""
    return spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(f"{folder}/batch=*")


def read_batch(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """One written batch; before the first there is an empty one."""
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch_id}") if batch_id >= 0 else spark.createDataFrame([], schema)

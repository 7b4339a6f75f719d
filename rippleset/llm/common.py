"""Helpers of the training-data operators: tables of an input folder, shared storage, Arrow batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that one Python call holds at a time; long texts are cut from larger Arrow batches without a copy.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where the session names none (tests, a laptop) a temporary folder becomes the checkpoint folder.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table on shared storage: later steps read files, so a lost executor costs no upstream work."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_small_batches(run: Callable) -> Callable:
    """``run(df, ...)`` while Spark hands ``BATCH_ROWS`` rows at a time to Python: rows of whole sets or texts stay small in memory."""

    @functools.wraps(run)
    def held(df: DataFrame, *args, **params):
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, str(BATCH_ROWS))
        try:
            return run(df, *args, **params)
        finally:
            conf.set(key, before)

    return held

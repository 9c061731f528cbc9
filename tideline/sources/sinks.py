"""Sinks (inventory K7, K14, T13): atomic output and recorders of live streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def replaced(df: DataFrame, path: str) -> None:
    """K7: ``df`` as Parquet at ``path`` in one step: it is written beside it,
    and takes its place by renames, so readers see the old table or the new one
    and a failed write leaves the old one.  ``path`` is in a file system."""
    spark = df.sparkSession
    fs, at = _path(spark, path.rstrip("/"))
    new, old = (_path(spark, f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}")[1] for kind in ("new", "old"))
    try:
        df.write.parquet(new.toString())
        if fs.exists(at):
            fs.rename(at, old)
        if not fs.rename(new, at):
            fs.rename(old, at)
            raise OSError(f"{path} could not be replaced")
    finally:
        fs.delete(new, True)
    fs.delete(old, True)


def recorder(path: str, by: str = "stream_id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch of rows becomes one folder of
    ``path``, replaced as a whole if the batch runs again after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        replaced(batch.repartition(F.col(by)).sortWithinPartitions(by), f"{path.rstrip('/')}/batch={number}")

    return write


def playlists(path: str, rows: Callable[[DataFrame], DataFrame], recorded: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: records the batch, then replaces the table of
    playlists at ``path`` by what ``rows`` makes of all recorded rows."""
    record = recorder(recorded)

    def write(batch: DataFrame, number: int) -> None:
        record(batch, number)
        replaced(rows(batch.sparkSession.read.parquet(recorded).drop("batch")), path)

    return write

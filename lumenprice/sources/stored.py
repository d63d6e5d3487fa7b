"""Tables that steps write to be read again: they cut the lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="lumenprice-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(rows: DataFrame, each: int) -> int:
    """Parts of about each rows, so that what a task holds doesn't grow with the table; no fewer than run at a time."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))

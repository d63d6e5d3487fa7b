"""Helpers that the training-data operators share: tables, staging, gapless positions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenprice.sources.stored import shared_dir

#: Bytes of an Arrow batch between Spark and Python: rows may be long texts.
BATCH_BYTES = 8 << 20
#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Cuts the lineage and survives lost executors: what is read later has been committed.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, that at its end gives freed memory back to the system: Spark keeps its Python workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a gapless position from 0 within each group, without one task per group.

    Rows go to buckets by a hash of the order columns; a bucket starts where the buckets before
    it end, so that a group of any size is numbered by many tasks. Ties in all order columns are
    numbered in any order.
    """
    n = 2 * partitions(df.sparkSession)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_start")
    )


def ordered_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the position from 0 in the order of the whole table, by range partitions.

    order must tell the rows apart. The partition numbers are stored before they are counted, so
    a lost task that samples other bounds can't change them.
    """
    n = partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_last() for c in order]
    dealt = staged(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_part")  # a row for each partition
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_part", "_row", "_start")
    )

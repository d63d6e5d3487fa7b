"""Numbers of rows, and maps of them that spare most rows a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered_index, staged

#: Bits of the maps; a false hit costs time only.
MAP_BITS = 23


def marked(rows: DataFrame) -> DataFrame:
    """The 2^MAP_BITS-bit map of rows' hashes: a row for each word that has a bit, at most 2^(MAP_BITS - 6)."""
    h = F.pmod(F.xxhash64("row"), F.lit(1 << MAP_BITS))
    return rows.select(F.shiftright(h, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(row), {1 << MAP_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def in_map(spark: SparkSession, rows: DataFrame):
    """A pandas UDF that tells of a row whether the map of rows has its bit, for the column xxhash64(row)."""
    found = marked(rows).toPandas()
    words = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    words[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(words)  # 1 MB whatever the input

    @F.pandas_udf("boolean")
    def there(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy(np.int64) % (1 << MAP_BITS)
        return pd.Series((held.value[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return there


def flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with _there: whether the map of found has the row's bit. A join with the map's words, so that no Python worker is needed."""
    words = marked(found).select(F.col("w").alias("_w"), F.col("b").alias("_bits"))
    h = F.pmod(F.xxhash64("row"), F.lit(1 << MAP_BITS))
    held = rows.withColumns({"_word": F.shiftright(h, 6), "_bit": F.pmod(h, F.lit(64))})
    held = held.join(F.broadcast(words), F.col("_word") == F.col("_w"), "left")  # 2^(MAP_BITS - 6) rows whatever the input
    there = F.expr("coalesce((shiftright(_bits, cast(_bit as int)) & 1) = 1, false)")
    return held.withColumn("_there", there).drop("_word", "_bit", "_w", "_bits")


def numbered(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text, the other columns, row: row orders the documents by doc_id and tells them apart.

    It is the doc_id where that is known and different everywhere. Else the rows are sorted by
    doc_id (null last) and text, and numbered.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text", *others)
    twice = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("doc_id").isNull() | (F.col("n") > 1))
    if not twice.limit(1).count():
        return own.withColumn("row", F.col("doc_id"))
    return staged(ordered_index(own, ["doc_id", "text"], "row"), "repeat-numbered")

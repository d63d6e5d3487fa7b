"""Upkeep of catalogue, partners and documents: upserts as joins, and a catalogue made from items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenprice.functions import text
from lumenprice.sources.stored import stored


def new_services(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Of incoming (service_name, icd_code, seq) the first of each normalised name and code that known doesn't have; nulls are equal."""
    key = lambda rows: rows.withColumn("norm", text.normalize(F.col("service_name")))
    first = Window.partitionBy("norm", "icd_code").orderBy("seq")
    rows = key(incoming).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    there = key(known).select(F.col("norm").alias("k_norm"), F.col("icd_code").alias("k_code")).distinct()
    return rows.join(there, F.col("norm").eqNullSafe(F.col("k_norm")) & F.col("icd_code").eqNullSafe(F.col("k_code")), "left_anti")


def new_partners(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Of incoming (name, bin, seq), in the order of seq, those whose BIN and normalised name no partner has: neither a known one nor an incoming one that is new itself.

    A round takes the rows that come first by BIN and by name, and drops the others with their BINs or names; rows that
    only met a dropped row wait for the next round. What a round leaves is stored, so that no plan grows with their number.
    """
    key = lambda rows: rows.withColumn("norm", text.normalize_name(F.col("name")))
    there = key(known)

    def others(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.filter("bin is not null").select("bin").distinct(), "bin", "left_anti").join(of.select("norm").distinct(), "norm", "left_anti")

    left = others(key(incoming), there).select(*incoming.columns, "norm")
    out = left.limit(0)
    while left.limit(1).count():
        by = lambda c: F.min("seq").over(Window.partitionBy(c))
        marked = left.withColumns({"first_name": by("norm"), "first_bin": by("bin")})
        first = marked.filter((F.col("seq") == F.col("first_name")) & (F.col("bin").isNull() | (F.col("seq") == F.col("first_bin")))).drop("first_name", "first_bin")
        first = stored(first, "partners-new")
        out, left = out.unionByName(first), stored(others(left, first).select(*left.columns), "partners-left")
    return out


def synthetic_catalog(items: DataFrame, least: int = 1) -> DataFrame:
    """A catalogue of the items' names (name, category, seq of any kind that has an order): the most frequent spelling (the first seen on a tie) of each
    normalised form names it, the others are synonyms, and the first known category holds."""
    spelt = items.withColumn("norm", text.normalize(F.col("name"))).filter("norm <> ''").groupBy("norm", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by("category", F.when(F.col("category").isNotNull(), F.col("seq"))).alias("category"),
        F.min(F.when(F.col("category").isNotNull(), F.col("seq"))).alias("c_seq"),
    )
    found = spelt.groupBy("norm").agg(
        F.sum("n").alias("n"), F.min_by("name", F.struct(-F.col("n"), F.col("seq"))).alias("service_name"), F.array_sort(F.collect_list("name")).alias("names"),
        F.min_by("category", "c_seq").alias("category"),
    )
    return found.filter(F.col("n") >= least).select("norm", "service_name", F.filter("names", lambda x: x != F.col("service_name")).alias("synonyms"), "category", "n")


def register(files: DataFrame, known: DataFrame) -> DataFrame:
    """Of files (doc_id, content) the first of each SHA-256 that known (file_hash) lacks."""
    rows = files.withColumn("file_hash", F.sha2("content", 256)).drop("content")
    first = Window.partitionBy("file_hash").orderBy("doc_id")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").join(known.select("file_hash"), "file_hash", "left_anti")


def archive(items: DataFrame, docs: DataFrame) -> DataFrame:
    """items, inactive where their document is taken in again (docs: doc_id)."""
    again = docs.select("doc_id").distinct().withColumn("again", F.lit(True))
    return items.join(again, "doc_id", "left").withColumn("is_active", F.col("is_active") & F.col("again").isNull()).drop("again")

"""Mixing sources to target weights (operator 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_index, staged, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of a table (source, source_size) with one row per source; null is a source, and the last.

    Together the targets are share times all sizes, dealt by weight; a target stops at most times
    its source's size, and the excess goes to the others by weight until none is above. The common
    factor solves sum(min(cap, factor * weight)) = total; each step of its iteration is one
    aggregate, and the steps rise to the solution since the sum is concave in the factor.
    """
    ranked = ordered_index(sizes, ["source"], "source_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    table = staged(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    factor, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(factor) * F.col("weight")
        step = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if step["open"] == 0 or step["capped"] == capped:
            break
        factor, capped = max(factor, (total - step["fixed"]) / step["open"]), step["capped"]
    return table.select("source", "source_size", F.least("cap", F.lit(factor) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """How often each document is taken: columns doc_id, size, source_size, target, rate, copies, taken, row_key.

    docs needs doc_id, text and source; other columns are left out here. The rate of a source is
    target / source_size; a document is taken floor(rate) times and once more if a hash of the
    seed, doc_id, source and text falls under the fraction, so that reruns agree and repeated rows are
    decided alike. Null and empty texts have size 0 and take no words; a source of size 0 has
    target and rate 0; a null source is a source of its own. An empty table gives an empty table.
    """
    rows = staged(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("row_key")),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"))
    targets = source_targets(sizes, weights, share, most).select(known.alias("_s"), "source_size", "target")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    lot = F.shiftrightunsigned("row_key", 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    return (
        rows.withColumn("_s", known)
        .join(targets, "_s")
        .withColumn("rate", rate)
        .withColumn("copies", (whole + F.when(lot < F.col("rate") - whole, 1).otherwise(0)).cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_key")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (also those of no words, by their rate).

    Columns as in docs; extra columns are carried along whatever their names.
    """
    seed = how.get("seed", 5)
    rates = mix(docs, **how)
    by_source = staged(rates.groupBy("source").agg(F.first("rate").alias("r")), "mix-rates")
    name = "_rate" + "_" * max(map(len, docs.columns), default=0)  # clashes with no column
    known = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rate = by_source.select(known.alias(name + "s"), F.col("r").alias(name))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 11) / F.lit(float(1 << 53))
    copies = (F.floor(name) + F.when(lot < F.col(name) - F.floor(name), 1).otherwise(0)).cast("int")
    return (
        docs.withColumn(name + "s", known)
        .join(rate, name + "s")
        .withColumn(name, F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )

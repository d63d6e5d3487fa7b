"""The most similar catalogue entries of names by the ratio of sorted tokens, found through an index of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenprice.operators.blocks import dealt, drawn, halvings, leaf, pruned_search, query_blocks
from lumenprice.operators.similarity import ratio, sorted_tokens
from lumenprice.sources.stored import stored

#: Kinds of letters that are counted; letters that share a kind only loosen the bound.
KINDS = 61


def letters(texts: list[str]) -> np.ndarray:
    """How many letters of each kind every text has."""
    out = np.zeros((len(texts), KINDS), np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % KINDS, minlength=KINDS)
    return out


def most_alike(own: np.ndarray, other: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The highest ratio that a text of letters own can have with one of letters other at most and a length from least to most.

    A common subsequence has no more letters of a kind than either text, and none is longer than a text; the ratio rises with
    the other's length up to the number of common letters, and falls behind it.
    """
    common = np.minimum(own, other).sum(axis=-1)
    length = np.clip(common, least, most)
    both = own.sum() + length
    return np.where(both > 0, 200.0 * np.minimum(common, length) / np.maximum(both, 1), 100.0)


def index(entries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of like entries (block, texts, owners, and an outline: most letters, shortest, longest), and owners by entry.

    entries has entry, service_id and seq; of an entry's owners the first k by (service_id, seq) can ever count.
    """
    owners = stored(top_owners(entries, k), "fuzzy-owners")
    one = owners.groupBy("entry").agg(F.min(F.struct("service_id", "seq")).alias("first"), F.count(F.lit(1)).alias("owned"))
    one = stored(one.select("entry", "first.service_id", "first.seq", "owned"), "fuzzy-entries")
    tree = halvings(letters([sorted_tokens(r["entry"]) for r in drawn(one, "entry", one.count()).select("entry").collect()]))  # about SAMPLE texts

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = leaf(tree, letters([sorted_tokens(t) for t in batch.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "cluster"])

    rows = stored(one.mapInArrow(cluster, "entry string, service_id long, seq int, owned long, cluster long"), "fuzzy-clustered")

    def to_block(own: pa.Table) -> pa.Table:
        counts = letters([sorted_tokens(t) for t in own.column("entry").to_pylist()])
        length = counts.sum(axis=1)
        cells = {"texts": own.column("entry").to_pylist(), "first": own.column("service_id").to_pylist(), "seqs": own.column("seq").to_pylist(), "owned": own.column("owned").to_pylist(), "most": counts.max(axis=0).tolist()}
        return pa.table({"block": [own.column("block")[0].as_py()], **{n: [c] for n, c in cells.items()}, "shortest": [int(length.min())], "longest": [int(length.max())]})

    shape = "block long, texts array<string>, first array<long>, seqs array<long>, owned array<long>, most array<long>, shortest long, longest long"
    return stored(dealt(rows, "entry").drop("cluster").groupBy("block").applyInArrow(to_block, shape), "fuzzy-blocks"), owners


def top_owners(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("entry").orderBy("service_id", "seq")
    return entries.select("entry", F.col("service_id").cast("long"), F.col("seq").cast("int")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def bounds(row: dict) -> np.ndarray:
    counts = letters([sorted_tokens(t) for t in row["entry"]])
    return np.array([most_alike(own, np.array(row["most"]), row["shortest"], row["longest"]) for own in counts])


def within(row: dict, visits: list[tuple[int, float]], k: int) -> list[tuple]:
    """(at, entry, ts, first owner's service_id and seq, owners, entries compared) of the k best entries of the block for each visitor.

    Entries are compared in the order of falling bounds, until those compared have k owners that nothing left can reach. A row without an
    entry tells what was compared in vain.
    """
    own = [sorted_tokens(t) for t in row["texts"]]
    counts = letters(own)
    length, out = counts.sum(axis=1), []
    for i, least in visits:
        name = sorted_tokens(row["entry"][i])
        most = most_alike(letters([name])[0], counts, length, length)
        found, tried = [], 0
        for j in np.argsort(-most, kind="stable").tolist():
            if most[j] < least:
                break
            tried += 1
            found.append((-ratio(name, own[j]), row["first"][j], row["seqs"][j], j))
            if tried % k == 0:
                found.sort()
                reached = np.cumsum([row["owned"][f[3]] for f in found])
                if reached[-1] >= k:
                    least = max(least, -found[int(np.searchsorted(reached, k))][0])
        kept = sorted(f for f in found if -f[0] >= least)[:k]
        out += [(row["ats"][i], row["texts"][j], -ts, s, n, row["owned"][j], tried) for ts, s, n, j in kept] or [(row["ats"][i], None, None, None, None, None, tried)]
    return out


def nearest_entries(names: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """entry_of (a name's normalised form), service_id, seq, entry, ts: for each distinct form the k rows of entries with the highest ratio of sorted tokens.

    names has entry_of; entries has entry, service_id, seq. Ties go to the smaller (service_id, seq). No pair is
    compared whose letters already rule it out, and none of the k is lost.
    """
    blocks, owners = index(entries, k)
    asked = stored(names.select(F.col("entry_of").alias("entry")).distinct().withColumn("at", F.monotonically_increasing_id()), "fuzzy-asked")
    queries, n = query_blocks(asked, ["entry"])

    def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        order = Window.partitionBy("at").orderBy(F.col("ts").desc(), "service_id", "seq")
        ranked = found.filter("entry is not null").withColumns({"_n": F.row_number().over(order), "_upto": F.sum("owned").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        # an entry behind k others has no owner among the first k, nor has one under the ratio at which k owners are there
        kept = ranked.filter(F.col("_n") <= k).withColumn("_least", F.max(F.when(F.col("_upto") >= k, F.col("ts"))).over(Window.partitionBy("at")))
        kept = stored(kept.filter(F.col("ts") >= F.coalesce("_least", F.lit(0.0))), "fuzzy-found")
        return kept.drop("_n", "_upto", "_least"), kept.filter("_least is not null").groupBy("at").agg(F.max("_least").alias("least"))

    schema = "at long, entry string, ts double, service_id long, seq int, owned long, tried long"
    found = pruned_search(blocks, queries, n, ["most", "shortest", "longest"], bounds, lambda row, visits: within(row, visits, k), schema, settle)
    rows = found.select("at", "entry", "ts").join(owners, "entry")
    best = Window.partitionBy("at").orderBy(F.col("ts").desc(), "service_id", "seq")
    return rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).join(asked.select("at", F.col("entry").alias("entry_of")), "at").select("entry_of", "service_id", "seq", "entry", "ts")

"""Queries against all rows of a catalogue in blocks, with the best k of each query, and bounds that spare blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenprice.sources.stored import stored

#: Catalogue rows and queries of a block, about.
ROWS, QUERIES = 2048, 256
#: Blocks a query visits, by falling bound, up to the end of each round.
ROUNDS = (1, 4, None)
#: Catalogue rows that clusters are fitted on, the fewest of them in a cluster and the most halvings.
SAMPLE, LEAST, LEVELS = 16_384, 32, 8


def top(found: DataFrame, k: int, key: list[str], order: list) -> DataFrame:
    """The k first of each key, with rank from 0."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).filter(F.col("rank") < k)


def drawn(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About SAMPLE of the n rows, the same whatever their order."""
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))


def halvings(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of each node of a tree that halves points at the median of their widest dimension; node i has 2 i + 1 and 2 i + 2 below it."""
    levels = max(0, min(LEVELS, int(np.log2(max(len(points) / LEAST, 1)))))
    dimension, cut = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, np.inf)
    open_ = [(0, np.arange(len(points)))]
    while open_:
        node, rows = open_.pop()
        if node < len(cut) and len(rows):
            dimension[node] = np.argmax(points[rows].var(axis=0))
            values = points[rows, dimension[node]]
            cut[node] = np.median(values)
            open_ += [(2 * node + 1, rows[values <= cut[node]]), (2 * node + 2, rows[values > cut[node]])]
    return dimension, cut


def leaf(tree: tuple[np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The cluster of each point, from 0."""
    dimension, cut = tree
    node = np.zeros(len(points), np.int64)
    while len(cut) and len(node) and node[0] < len(cut):
        node = 2 * node + 1 + (points[np.arange(len(points)), dimension[node]] > cut[node])
    return node - len(cut)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (with cluster) with block: about ROWS rows of one cluster, dealt by key, however large the cluster is."""
    per = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}  # a number for each of a bounded number of clusters
    parts = F.array(*[F.lit(-(-per.get(c, 1) // ROWS)) for c in range(max(per, default=0) + 1)])
    return rows.withColumn("block", F.col("cluster") * (1 << 40) + F.pmod(F.xxhash64(key), F.get(parts, F.col("cluster").cast("int"))))


def query_blocks(queries: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """A row for about QUERIES rows of queries (at and columns, each as an array in one order), and how many there are at most."""
    n = max(1, -(-queries.count() // QUERIES))
    own = F.array_sort(F.collect_list(F.struct("at", *columns)))
    grouped = queries.groupBy(F.pmod(F.xxhash64("at"), F.lit(n)).alias("qb")).agg(own.alias("own"))
    return stored(grouped.select("qb", *[F.col(f"own.{c}").alias(name) for c, name in [("at", "ats"), *[(c, c) for c in columns]]]), "query-blocks"), n


def _beside(blocks: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """blocks, which name a block of queries each, beside it; a block of queries goes to groups places, so that no key is hot."""
    spread = queries.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).join(spread, ["qb", "group"]).drop("group")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def pruned_search(
    blocks: DataFrame, queries: DataFrame, n_queries: int, outline: list[str], bound: Callable[[dict], np.ndarray],
    score: Callable[[dict, list[tuple[int, float]]], list[tuple]], schema: str, settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
) -> DataFrame:
    """What score finds for each query in the blocks that can hold something for it, as settle leaves it.

    bound gives, from a block's outline columns and a block of queries, the most that anything there can score for each query
    (below 0: nothing). A query visits the blocks in the order of falling bounds, in ROUNDS, and leaves out those under what it has reached:
    settle(found) gives what is to be kept and each query's least (at, least), which may only rise. score gets a row of both
    sides and (place of the query, least) of its visitors.
    """
    groups = max(1, -(-blocks.count() // 8))

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            most = np.asarray(bound(row), float)
            some = np.flatnonzero(most >= 0)
            columns = [pa.array(np.full(len(some), row[c]), pa.int64()) for c in ("block", "qb")] + [pa.array(np.array(row["ats"], np.int64)[some]), pa.array(most[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "qb", "at", "bound"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long")))
    most = stored(_beside(blocks.select("block", *outline, every.alias("qb")), queries, groups).mapInArrow(limits, "block long, qb long, at long, bound double"), "query-bounds")
    order = most.withColumn("turn", F.row_number().over(Window.partitionBy("at").orderBy(F.col("bound").desc(), "block")))
    spark, names = blocks.sparkSession, [f.split()[0] for f in schema.split(", ")]
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = {a: i for i, a in enumerate(row["ats"])}
            out = score(row, [(at[v["at"]], v["least"]) for v in row["visits"]])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    found = least = None
    first = 0
    for last in ROUNDS:
        visits = order.filter((F.col("turn") > first) & (F.col("turn") <= last) if last else F.col("turn") > first)
        visits = visits.withColumn("least", F.lit(-1.0)) if least is None else visits.join(least, "at", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))).filter("bound >= least")
        per = visits.groupBy("block", "qb").agg(F.collect_list(F.struct("at", "least")).alias("visits"))
        hits = _beside(blocks.join(per, "block"), queries, groups).mapInArrow(scores, schema)
        found, least = settle(hits if found is None else hits.unionByName(found))
        first = last
    return found

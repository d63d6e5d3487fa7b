"""Exact nearest vectors by cosine, in blocks around pivots that the triangle inequality spares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenprice.operators.blocks import LEAST, dealt, drawn, pruned_search, query_blocks, top
from lumenprice.sources.stored import stored

#: Most pivots; they are fitted on a bounded sample, and every vector belongs to the nearest.
PIVOTS = 256


def unit(rows: DataFrame) -> DataFrame:
    """at, id, v: the vectors that are neither null nor empty nor zero nor hold null, scaled to length 1 and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, float) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(v / np.linalg.norm(v)).tobytes() for v in vectors], pa.binary())], names=["id", "v"])

    ok = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return stored(rows.filter(ok).select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, v binary").withColumn("at", F.monotonically_increasing_id()), "neighbours")


def matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells)).reshape(len(cells), -1)


def pivots(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors among which the sample falls into like groups: a few rounds of means from rows drawn by a fixed seed."""
    n = int(np.clip(len(vectors) // (2 * LEAST), 1, PIVOTS))
    found = vectors[np.sort(np.random.default_rng(3).permutation(len(vectors))[:n])]
    for _ in range(4):
        nearest = np.argmax(vectors @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), found)
    return found


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def around(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors of one pivot: block, ids, vectors, pivot, radius (the widest angle to the pivot)."""
    centres = pivots(matrix([r["v"] for r in drawn(vectors, "at", vectors.count()).select("v").collect()]))  # about SAMPLE vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.argmax(matrix(batch.column(1).to_pylist()) @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "cluster"])

    rows = stored(vectors.select("id", "v", "at").mapInArrow(nearest, "id long, v binary, at long, cluster long"), "neighbour-clusters")

    def to_block(own: pa.Table) -> pa.Table:
        v, pivot = matrix(own.column("v").to_pylist()), centres[own.column("cluster")[0].as_py()]
        return pa.table({"block": [own.column("block")[0].as_py()], "ids": [own.column("id").to_pylist()], "vectors": [v.tobytes()], "pivot": [pivot.tobytes()], "radius": [float(angles(v @ pivot).max())]})

    return stored(dealt(rows, "at").groupBy("block").applyInArrow(to_block, "block long, ids array<long>, vectors binary, pivot binary, radius double"), "neighbour-blocks")


def bounds(row: dict) -> np.ndarray:
    """1 + the highest cosine that a vector within the radius of the pivot can have with each query."""
    to_pivot = angles(matrix(row["v"]) @ np.frombuffer(row["pivot"]))
    return 1 + np.cos(np.maximum(0, to_pivot - row["radius"])) + 1e-9


def within(row: dict, visits: list[tuple[int, float]], k: int) -> list[tuple]:
    ids = np.array(row["ids"])
    places = [i for i, _ in visits]
    cosines, out = matrix([row["v"][i] for i in places]) @ matrix([row["vectors"]]).reshape(len(ids), -1).T, []
    for own, (i, least) in zip(cosines, visits):
        some = np.flatnonzero((ids != row["id"][i]) & (1 + own >= least - 1e-9))
        some = some[np.lexsort((ids[some], -own[some]))][:k]
        out += [(row["ats"][i], row["id"][i], int(ids[j]), float(own[j]), len(ids)) for j in some] or [(row["ats"][i], row["id"][i], None, None, len(ids))]
    return out


def nearest(queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """query_id, id, score (not below 0), rank: the k rows of catalog of the largest cosine with each query, ties by smaller id.

    Both have id and embedding of one width. A query isn't its own neighbour; vectors that are null, empty, zero or hold null take no part.
    A block around a pivot is left out where the query's angle to the pivot less the block's radius is
    wider than that of what it has: no neighbour is lost.
    """
    vectors, asked = unit(catalog), unit(queries)
    shape = "query_id long, id long, score double, rank int"
    if not vectors.limit(1).count() or not asked.limit(1).count():
        return queries.sparkSession.createDataFrame([], shape)
    packs, n = query_blocks(asked, ["id", "v"])

    def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = stored(top(found.filter("other is not null"), k, ["at"], [F.col("score").desc(), "other"]), "neighbours-found")
        return kept.drop("rank"), kept.filter(F.col("rank") == k - 1).select("at", (1 + F.col("score")).alias("least"))

    found = pruned_search(around(vectors), packs, n, ["pivot", "radius"], bounds, lambda row, visits: within(row, visits, k), "at long, query_id long, other long, score double, compared long", settle)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.col("score").desc(), "other")) - 1)
    return ranked.select("query_id", F.col("other").alias("id"), F.greatest("score", F.lit(0.0)).alias("score"), "rank")

"""Approximate nearest neighbours by cross-polytope hashing (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import staged
from .topk import ranked
from .vectors import best, matrix, packed, width_of

#: Tables, and the signed axes that a query probes in each.
TABLES, PROBES = 16, 8
#: Rows of a bucket that one task compares at a time; larger buckets are dealt to several tasks.
BLOCK = 8_192


def hadamard(m: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    m, width, step = m.copy(), m.shape[1], 1
    while step < width:
        pairs = m.reshape(len(m), -1, 2, step)
        m = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(m), width)
        step *= 2
    return m / np.sqrt(width)


class Hash:
    """Cross-polytope hashes: three rounds of random signs and the Hadamard transform, then the nearest signed axis."""

    def __init__(self, width: int, tables: int, largest: float, level: bool, seed: int = 8):
        #: If norms differ, one more component makes all rows as long as the largest and keeps the order of inner products.
        self.width, self.largest, self.level = width, largest, level
        self.padded = 1 << max(1, int(np.ceil(np.log2(width + (not level)))))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.padded))

    def rotated(self, m: np.ndarray, table: int, query: bool) -> np.ndarray:
        wide = np.zeros((len(m), self.padded))
        norm = np.linalg.norm(m, axis=1)
        wide[:, : self.width] = m / (norm if query or self.level else np.full(len(m), self.largest))[:, None]
        if not query and not self.level:
            wide[:, self.width] = np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))
        for signs in self.signs[table]:
            wide = hadamard(wide * signs)
        return wide

    def buckets(self, m: np.ndarray, table: int, query: bool, probes: int) -> np.ndarray:
        """The nearest signed axes of each row, nearest first: axis i, or padded + i for its opposite."""
        turned = self.rotated(m, table, query)
        both = np.concatenate([turned, -turned], axis=1)
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores (-inf: none), ties by smaller id, and few besides that round to the k-th."""
    if scores.shape[1] <= k:
        return np.nonzero(scores > -np.inf)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    near = (scores >= (edge - 1e-12 * np.abs(edge))[:, None]) & (scores > -np.inf)
    for r in np.flatnonzero(near.sum(axis=1) > 2 * k):  # many copies of one vector: the smallest ids are enough
        some = np.flatnonzero(near[r])
        near[r] = False
        near[r, some[best(np.where(scores[r, some] <= edge[r] + 1e-12 * abs(edge[r]), edge[r], scores[r, some]), ids[some], k)]] = True
    return np.nonzero(near)


def nearest(vectors: DataFrame, is_query: Column, k: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest inner product among those that its buckets hold.

    vectors has vec_id and embedding. Rows that are null, zero or hold null or non-finite
    components take no part; repeated rows are rows of their own, and only the query's own row is no
    candidate; shorter vectors count as ending in zeros; ties go to the smaller vec_id. Every row is in
    one bucket of every table; all rows of a probed bucket are compared, by the inner product of the
    original vectors in double precision. A query whose buckets hold fewer than k others probes
    every bucket. An empty table gives no rows; other columns don't matter.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # single precision stays so on its way, which loses nothing; it is widened before anything is computed
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = np.float32 if single else np.float64
    rows = staged(packed(vectors, "vec_id", "embedding", kind).withColumn("at", F.monotonically_increasing_id()), "ann-rows")
    width = width_of(rows, kind)
    if not width:
        return empty

    def wide(column) -> np.ndarray:
        return matrix(column, width, kind).astype(np.float64)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(wide(batch.column(0).to_pylist()), axis=1))], names=["n"])

    span = rows.select("v").mapInArrow(norms, "n double").filter("n > 0").agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if span["high"] is None:
        return empty
    hashes = Hash(width, tables, span["high"], span["low"] >= span["high"] * (1 - 1e-3))

    def hashed(query: bool, n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = wide(batch.column("v").to_pylist())
                there = np.flatnonzero((m != 0).any(axis=1))
                for start in range(0, len(there), 4096):
                    own = there[start : start + 4096]
                    for t in range(tables):
                        found = hashes.buckets(m[own], t, query, n)
                        times = np.repeat(own, found.shape[1])
                        picked = batch.take(pa.array(times))
                        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.full(len(times), t, np.int32)), pa.array(found.ravel().astype(np.int32))], names=[*names, "t", "bucket"])

        return run

    names = ["vec_id", "v", "at"]
    schema = "vec_id long, v binary, at long, t int, bucket int"
    members = rows.select(*names).mapInArrow(hashed(False, 1), schema)
    sizes = staged(members.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")), "ann-sizes").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    sizes = F.broadcast(sizes)  # a row for each signed axis and table

    def found(queries: DataFrame, n: int) -> DataFrame:
        probing = queries.select(*names).mapInArrow(hashed(True, n), schema).join(sizes, ["t", "bucket"])
        probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        dealt = members.join(sizes, ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).drop("blocks")

        def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not (len(c) and len(q)):
                return pd.DataFrame({"query_at": [], "query_id": [], "at": [], "vec_id": [], "score": []})
            cm, c_at, c_id = wide(c["v"]), c["at"].to_numpy(), c["vec_id"].to_numpy()
            qm, q_at, q_id = wide(q["v"]), q["at"].to_numpy(), q["vec_id"].to_numpy()
            out = []
            for i in range(0, len(q), 512):
                x, y = k_best(np.where(c_at[None, :] == q_at[i : i + 512, None], -np.inf, qm[i : i + 512] @ cm.T), c_id, k)
                exact = np.concatenate([np.einsum("ij,ij->i", qm[i + x[j : j + 50_000]], cm[y[j : j + 50_000]]) for j in range(0, len(x), 50_000)] or [np.empty(0)])
                out.append(pd.DataFrame({"query_at": q_at[i + x], "query_id": q_id[i + x], "at": c_at[y], "vec_id": c_id[y], "score": exact}))
            return pd.concat(out)

        key = ["t", "bucket", "block"]
        each = dealt.groupBy(*key).cogroup(probing.groupBy(*key)).applyInPandas(compare, "query_at long, query_id long, at long, vec_id long, score double")
        return each.groupBy("query_at", "query_id", "at", "vec_id").agg(F.max("score").alias("score"))

    queries = rows.filter(is_query)
    first = staged(found(queries, probes), "ann-found")
    rows_n = rows.limit(k + 1).count()
    short = queries.join(first.groupBy("query_at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, rows_n - 1)), F.col("at") == F.col("query_at"), "left_anti")
    short = staged(short.select(*names), "ann-short")
    if short.limit(1).count():
        more = found(short, 2 * hashes.padded)
        first = first.join(short.select(F.col("at").alias("query_at")), "query_at", "left_anti").unionByName(more)
    return ranked(first, k).select("query_id", "rank", "vec_id", "score")

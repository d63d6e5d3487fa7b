"""Exact top-k inner products, norm-sorted and pruned on rotated partial sums (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_index, staged
from .vectors import best, matrix, packed, width_of

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 2_048
#: Shares of the rotated dimensions after which pairs are pruned, and the share of pairs left at which the rest are computed one by one.
STEPS, FEW = (0.25, 0.5, 0.75), 0.05
FOUND = "query_at long, query_id long, vec_id long, score long"


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first, from the sum of their outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0).to_pylist(), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "x"])

    sums = vectors.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros(width * width)
    gram[sums["i"].to_numpy()] = sums["x"].to_numpy()
    gram = gram.reshape(width, width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def search(candidates: pd.DataFrame, queries: pd.DataFrame, rotate: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of the block for each query whose threshold they reach; the row itself is none."""
    width = len(rotate)
    c, q = matrix(candidates["v"], width), matrix(queries["v"], width)
    c_at, c_id = candidates["at"].to_numpy(), candidates["vec_id"].to_numpy()
    exact = float((np.abs(c).max(initial=0) * np.abs(q).max(initial=0)) * width) < 2.0**53
    cr, norms = c @ rotate, np.linalg.norm(c, axis=1)
    stops = sorted({max(1, int(s * width)) for s in STEPS}) if width > 1 else []
    rests = [np.sqrt(np.maximum((cr[:, s:] ** 2).sum(axis=1), 0)) for s in stops]
    out = []
    for i in range(0, len(q), 256):
        own, low = q[i : i + 256], queries["least"].to_numpy(float)[i : i + 256]
        qr, q_norm = own @ rotate, np.linalg.norm(own, axis=1)
        # rounding of the rotated sums; a pair is dropped only where it surely stays under the threshold
        slack = 1e-9 * q_norm[:, None] * norms.max(initial=0) + 0.5
        partial, before, pairs = np.zeros((len(own), len(c))), 0, None
        for stop, rest in zip(stops, rests):
            partial += qr[:, before:stop] @ cr[:, before:stop].T
            before = stop
            rest_q = np.sqrt((qr[:, stop:] ** 2).sum(axis=1))
            open_ = partial + rest_q[:, None] * rest[None, :] + slack >= low[:, None]
            if open_.mean() <= FEW:
                pairs = np.nonzero(open_)
                break
        if pairs is None:
            scores = own @ c.T if exact else (own.astype(np.int64) @ c.T.astype(np.int64))
            reach = scores >= low[:, None]
        else:
            scores = np.full((len(own), len(c)), -np.inf)
            x, y = pairs
            for j in range(0, len(x), 100_000):
                a, b = own[x[j : j + 100_000]], c[y[j : j + 100_000]]
                scores[x[j : j + 100_000], y[j : j + 100_000]] = np.einsum("ij,ij->i", a, b)
            reach = scores >= low[:, None]
        for j in range(len(own)):
            at, name = queries["at"].iat[i + j], queries["vec_id"].iat[i + j]
            some = np.flatnonzero(reach[j] & (c_at != at))
            some = some[best(scores[j, some], c_id[some], k)]
            out.append(pd.DataFrame({"query_at": at, "query_id": name, "vec_id": c_id[some], "score": scores[j, some].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_at": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_at").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    vectors has vec_id and embedding; each component x becomes floor(scale * x). Rows that are
    null or hold null or non-finite components take no part; repeated rows are rows of their own
    (one may be found for the other); shorter vectors count as ending in zeros; ties go to the
    smaller vec_id; an empty table gives no rows; other columns don't matter.

    Rows are put in the order of falling norm and cut into blocks. The first block gives each query a
    threshold, its k-th best score so far; it meets a later block only if its norm times the
    block's largest norm reaches that, and a pair there only while the partial sum over the leading singular
    directions plus the product of what is left of both norms reaches it.
    """
    spark = vectors.sparkSession

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.floor(scale * np.frombuffer(x)) for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([-float(np.sqrt((x**2).sum())) for x in v], pa.float64())], names=["vec_id", "v", "minus_norm"])

    rows = staged(packed(vectors, "vec_id", "embedding").mapInArrow(whole, "vec_id long, v binary, minus_norm double"), "topk-rows")
    width = width_of(rows)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotate = rotation(rows, width)
    ordered = staged(ordered_index(rows, ["minus_norm", "vec_id", "v"], "at"), "topk-ordered").withColumn("block", F.floor(F.col("at") / CANDIDATES))
    tops = ordered.groupBy("block").agg(F.max(-F.col("minus_norm")).alias("n")).orderBy("block").toPandas()["n"].to_numpy()  # a number for CANDIDATES rows
    queries = ordered.filter(is_query).withColumn("q_block", F.pmod(F.xxhash64("at"), F.lit(max(1, -(-ordered.filter(is_query).count() // QUERIES)))))

    def meet(at_blocks: DataFrame, of_queries: DataFrame) -> DataFrame:
        """Blocks of candidates with blocks of queries: every candidate goes to each block of queries that reaches it."""
        # new names for the same rows: both sides come from one table
        of_queries = of_queries.select(*[F.col(c).alias(c) for c in ("at", "vec_id", "v", "least", "block", "q_block")])
        pairs = of_queries.select("block", "q_block").distinct()
        left = at_blocks.select("at", "vec_id", "v", "block").join(pairs, "block")
        left = left.select(*[F.col(c).alias(c) for c in ("at", "vec_id", "v", "block", "q_block")]).groupBy("block", "q_block")
        right = of_queries.groupBy("block", "q_block")

        def both(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return search(c, q, rotate, k)

        return left.cogroup(right).applyInPandas(both, FOUND)

    first = staged(meet(ordered.filter("block = 0"), queries.drop("block").withColumn("block", F.lit(0).cast("long")).withColumn("least", F.lit(float("-inf")))), "topk-first")
    least = first.groupBy("query_at").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    known = queries.drop("block").join(least, F.col("at") == F.col("query_at"), "left")
    known = known.withColumn("least", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf"))))
    if len(tops) > 1:
        edges = F.array(*[F.lit(float(t)) for t in tops[1:]]) if len(tops) <= 1000 else None
        reach = F.col("least") / F.greatest(-F.col("minus_norm"), F.lit(1e-300)) * (1 - 1e-12)
        if edges is None:
            steps = spark.sparkContext.broadcast(-tops[1:])

            @F.pandas_udf("int")
            def reached(low: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(steps.value, -low.to_numpy(), "right").astype(np.int32))

            count = reached(reach)
        else:
            count = F.size(F.filter(edges, lambda t: t >= reach))
        rest = known.withColumn("block", F.explode(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(F.array().cast("array<long>"))))
        first = first.unionByName(meet(ordered.filter("block > 0"), rest))
    return ranked(first, k).select("query_id", "rank", "vec_id", "score")

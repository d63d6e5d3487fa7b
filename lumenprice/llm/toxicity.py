"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, staged

#: Lengths of the n-grams, and the bits of their hashes.
ORDERS, BITS = (3, 4, 5), 18
#: The classifier is fitted on so many labelled rows at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 16_000
#: n-grams are features if so many training rows have them, and their chi-squared and the size of their log-count ratio are at least these.
LEAST_ROWS, LEAST_CHI2, LEAST_RATIO = 5, 8.0, 1.0
THRESHOLD = 0.3

MULTIPLIERS = np.random.default_rng(6).integers(1 << 62, 1 << 63, max(ORDERS), dtype=np.uint64) | np.uint64(1)


def ngrams(text: str) -> np.ndarray:
    """Hashes (below 2^BITS, with repeats) of a lower-cased text's character n-grams; white space is a blank at the ends too."""
    chars = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars[(chars <= 32) | (chars == 160)] = 32
    out = []
    sums = np.zeros(len(chars), np.uint64)
    for k in range(max(ORDERS)):
        if len(chars) <= k:
            break
        sums = sums[: len(chars) - k] + chars[k:] * MULTIPLIERS[k]
        if k + 1 in ORDERS:
            mixed = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    """weights: of each hash, the classifier's weight times the log-count ratio (0: no feature)."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        codes = ngrams(text or "")
        codes = codes[self.weights[codes] != 0]
        total = self.bias + float(self.weights[np.unique(codes)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def counts(rows: DataFrame) -> pd.DataFrame:
    """Of each hash, in how many rows (text, toxic) of either class it occurs; 2^BITS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[toxic][np.unique(ngrams(text or ""))] += 1
        code = np.flatnonzero(found.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(found[0][code]), pa.array(found[1][code])], names=["code", "clean", "toxic"])

    return rows.select("text", "toxic").mapInArrow(giving_back(run), "code long, clean long, toxic long").groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labels (doc_id, toxic: 0 or 1) and the texts of docs (doc_id, text).

    Takes at most train_rows labelled rows, so that the driver's part has a fixed bound; rows without a
    label, or without a document, teach nothing. If only one class or none is there, the model
    is the share of the class alone.
    """
    spark = docs.sparkSession
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(train_rows).toPandas()
    few = spark.createDataFrame([(int(a), int(b)) for a, b in zip(chosen["doc_id"], chosen["toxic"])], "doc_id long, toxic int")
    rows = staged(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id"), "toxic-train")  # few has train_rows rows at most
    by_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean_n, toxic_n = by_class.get(0, 0), by_class.get(1, 0)
    weights, bias = np.zeros(1 << BITS, np.float32), float(np.log((toxic_n + 0.5) / (clean_n + 0.5)))
    if not clean_n or not toxic_n:
        return Model(weights, bias)
    found = counts(rows)
    p, q = (found["toxic"].to_numpy(float)), (found["clean"].to_numpy(float))
    ratio = np.log((p + 1) / (toxic_n + 2)) - np.log((q + 1) / (clean_n + 2))
    n, both = clean_n + toxic_n, p + q
    expected = both * toxic_n / n
    chi2 = (p - expected) ** 2 * n**2 / np.maximum(both * (n - both) * toxic_n * clean_n / n, 1e-9)
    keep = (both >= LEAST_ROWS) & (chi2 >= LEAST_CHI2) & (np.abs(ratio) >= LEAST_RATIO)
    if not keep.any():
        return Model(weights, bias)
    code, ratio = found["code"].to_numpy()[keep], ratio[keep]
    index = np.full(1 << BITS, -1, np.int32)
    index[code] = np.arange(len(code))
    index_of = spark.sparkContext.broadcast(index)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(index_of.value[ngrams(t or "")]) for t in batch.column("text").to_pylist()]
            lists = pa.array([f[f >= 0] for f in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("toxic")], names=["features", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(giving_back(features), "features array<int>, toxic int").toArrow()
    lists = table.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    row, column = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
    w, bias = logistic(row, column, ratio, table.column("toxic").to_numpy().astype(float))
    weights[code] = (w * ratio).astype(np.float32)
    return Model(weights, bias)


def logistic(row: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times log-count ratio, by accelerated gradient descent from zero."""
    n, m = len(y), len(ratio)
    scale = ratio[column]
    size = np.bincount(row, minlength=n)
    # the steepest curve is at most a quarter of the largest eigenvalue, found by power iteration
    v = np.ones(m)
    for _ in range(15):
        z = np.bincount(row, scale * v[column], n)
        v = np.bincount(column, scale * z[row], m)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1 / (0.25 * (top + n) / n + penalty)
    w, bias = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(row, scale * ahead[column], n) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = ahead - rate * (np.bincount(column, scale * error[row], m) / n + penalty * ahead)
        new_bias = ahead_bias - rate * error.mean()
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return w, bias


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs (with a column text) and a column of scores from 0 to 1; null texts are scored as empty ones.

    Every row and other column of docs is kept; name must not be one of them.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score, na_action=None).astype(float)

    return docs.withColumn(name, of(F.col("text")))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text and others) that score under threshold, with a model as in classify."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"), train_rows)
    name = "_" * (1 + max(map(len, docs.columns)))  # no column's name
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, with a model fitted on the labels of the other rows."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"), train_rows)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

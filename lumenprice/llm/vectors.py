"""Vectors as packed bytes, so that tasks turn rows into matrices without loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, id_column: str, column: str, kind=np.float64) -> DataFrame:
    """vec_id and v (the components as numbers of a kind, packed) of the vectors that are not null and hold only finite components.

    An empty array has no components and is kept as an empty vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if value.is_valid and not (value.values.null_count if len(value.values) else 0):
                    v = value.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(v).all():
                        ids.append(name)
                        out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col(id_column).cast("long"), F.col(column)).mapInArrow(run, "vec_id long, v binary")


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """Rows of packed vectors as a matrix; shorter ones end in zeros."""
    values = list(column)
    size = width * np.dtype(kind).itemsize
    joined = b"".join(v if len(v) == size else v + bytes(size - len(v)) for v in values)
    return np.frombuffer(joined, kind).reshape(len(values), width)


def width_of(rows: DataFrame, kind=np.float64) -> int:
    """The most components of a vector in packed rows."""
    return int((rows.agg(F.max(F.octet_length("v")).alias("n")).first()["n"] or 0) // np.dtype(kind).itemsize)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties by smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]

"""Exact top-k against brute force, and the recall of the cross-polytope search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenprice.llm import ann, topk
from lumenprice.llm.ann import hadamard


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.2, 2, (600, 1))
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    out[7] = (7, out[50][1])  # a tie
    return [*out, (50, out[50][1]), (700, None), (701, [float("nan")] * 16), (702, [None] + [1.0] * 15), (703, [0.0] * 16), (704, [1.0, 2.0]), (750, [])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<double>, at int, block string").repartition(5)


def padded(v):
    return np.array([*v, *[0.0] * (16 - len(v))])


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [16_384, 64])
def test_top_k(table, rows, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    known = [(i, np.floor(256 * padded(v)).astype(np.int64)) for i, v in rows if usable(v)]
    want = []
    for n, (i, q) in enumerate(known):
        if i % 50 == 0:
            scored = sorted((-int(q @ c), j) for m, (j, c) in enumerate(known) if m != n)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    found = topk.top_k(table, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 3, 256 * 256 * 3)]
    assert [tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()] == [(0, 1, 3, 3.0)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0, 5).count() == ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_hadamard_keeps_lengths():
    m = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(hadamard(m), axis=1), np.linalg.norm(m, axis=1)) and np.allclose(hadamard(hadamard(m)), m)


def test_recall(table, rows):
    known = [(i, padded(v)) for i, v in rows if usable(v) and any(v)]
    found: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], []).append(r)
    values = dict(known)
    hit = total = 0
    for n, (i, q) in enumerate(known):
        if i % 20 or i == 50:
            continue
        own = sorted(found[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float(q @ values[r["vec_id"]]), abs=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        true = [j for _, j in sorted((-float(q @ c), j) for m, (j, c) in enumerate(known) if m != n)[:20]]
        hit += len(set(true) & {r["vec_id"] for r in own})
        total += 20
    assert hit / total >= 0.9

"""Hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenprice.llm import negatives

LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
SCHEMA = "vec_id long, embedding array<float>, label int, at int, rank string"


def rows():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.1, 2, (1500, 1))
    out = [(i, x.astype(np.float32).tolist(), int(rng.integers(3))) for i, x in enumerate(v)]
    for i in (150, 151, 152, 153):  # ties and copies of an anchor
        out[i] = (i, out[100][1], i % 3)
    nan, inf = float("nan"), float("inf")
    return [*out, (100, out[100][1], 0), (100, out[100][1], 1), (1600, None, 1), (1700, [nan] * 16, 1), (1800, [None] + [1.0] * 15, 1), (1900, [inf] * 16, 1), (2000, [1.0] * 16, None), (2100, [], 1), (2200, [3.0, -2.0], 1), (2300, [0.0] * 16, 2), (2400, [1.0] * 16, 9), (None, [1.0] * 16, 1)]


def brute(rows):
    known = []
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            known.append((i, np.floor(256 * np.array([*v, *[0.0] * (16 - len(v))])).astype(np.int64), label))
    matrix = np.stack([k[1] for k in known])
    out = []
    for n, (i, v, label) in enumerate(known):
        if i is None or i % 100:
            continue
        s = (matrix @ v).tolist()
        order = sorted((m for m in range(len(known)) if m != n), key=lambda m: (-s[m], known[m][0] is None, known[m][0]))
        for p in [m for m in order if known[m][2] == label][:5]:
            found = [m for m in order if known[m][2] != label and 80 * s[p] <= 100 * s[m] <= 100 * s[p]][:5]
            out += [(i, known[p][0], r + 1, known[m][0], s[p], s[m]) for r, m in enumerate(found)]
    return out


@pytest.mark.parametrize("block, few", [(16_384, 0.1), (100, 1.0), (300, 0.0)])
def test_hard_negatives(spark, monkeypatch, block, few):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", min(block, 1024))
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SLAB", 7)
    monkeypatch.setattr(negatives, "FEW", few)
    own = rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in own], SCHEMA).repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, F.expr(LABEL)).collect()
    assert sorted(map(key, found)) == sorted(map(key, brute(own)))


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0, 1, "x"), (3, [1.0, 1.0], 0, 1, "x"), (4, [1.0, 0.9], 1, 1, "x")], SCHEMA)
    mined = lambda f: [tuple(r) for r in negatives.hard_negatives(f, F.col("vec_id") % 100 == 0, F.col("label")).collect()]
    assert mined(frame) == [(0, 3, 1, 4, 3 * 65536, 256 * 256 + 512 * 230)]
    assert mined(frame.filter("vec_id < 4")) == mined(frame.filter("vec_id > 0")) == mined(frame.limit(0)) == []
    with pytest.raises(Exception, match="64 bits"):
        mined(frame.withColumn("embedding", F.expr("array(1e30f)")))


def test_bits():
    for least, most in ((0, 0), (-1, 0), (-256, 255), (-257, 3), (0, 256), (3, 4)):
        bits = negatives.bits_of(least, most)
        assert -(1 << bits - 1) <= least and most < 1 << bits - 1
        v = np.arange(least, most + 1)[:, None]
        planes = np.unpackbits(negatives.slices(v, bits), axis=2, count=1).astype(int)
        weights = [-(1 << bits - 1)] + [1 << k for k in range(bits - 2, -1, -1)]
        assert (sum(w * p for w, p in zip(weights, planes)) == v).all()

"""Ranked lexical search against brute force, the SQL of the queries against the queries, and the bisection."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenprice.llm import lexical, queries
from lumenprice.llm.bisection import routed, tree

from .conftest import words

FOLD = str.maketrans(lexical.UPPER, lexical.UPPER.lower())


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(FOLD))


def brute(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def texts():
    rng = random.Random(8)
    groups = [words(rng, 40, 400) for _ in range(12)]
    out = []
    for i in range(700):
        own = [rng.choice(groups[i % 12]) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))]
        out.append((i, " ".join(own)))
    out += [(700 + i, out[3][1]) for i in range(90)]  # a hot group of copies
    odd = "W1 w2, W3-w4 \u00c4rger \u00e4rger \u0130 x\u0000y \u2003w5\u2003 \U0001f600 \u00aa " + "w7 " * 3000
    docs = [*out, (5, "w1 w1"), (5, "w1 w1"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "- , ."), (903, odd)]
    items = [(i, " ".join(rng.choice(groups[i % 12]) for _ in range(rng.randrange(1, 12)))) for i in range(30)]
    return docs, [*items, (30, None), (31, ""), (32, "never-seen"), (33, out[3][1]), (3, "w1 w1 W1 w2"), (34, "\u00c4rger \u2003w5\u2003 x y"), (None, "w1")]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, make_docs, monkeypatch, small):
    if small:
        for name, value in {"DICTIONARY": 0, "SAMPLE": 300, "LEAST_DOCS": 20, "LEAST_SAMPLE": 4, "SHARD": 16, "ITEMS": 5, "PIECE": 50}.items():
            monkeypatch.setattr(lexical, name, value)
    else:
        monkeypatch.setattr(lexical, "PIECE", 50)
        monkeypatch.setattr(lexical, "LEAST_DOCS", 40)
    docs, items = texts()
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, tid string").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    found = sorted(map(key, lexical.search(make_docs(docs), asked).collect()))
    want = sorted(map(key, brute(docs, items)))
    assert found == want


def test_few_rows(spark, make_docs):
    docs, items = make_docs([(1, "a b"), (2, None)]), spark.createDataFrame([(1, "b B c")], "item_id long, text string")
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == brute([(1, "a b"), (2, None)], [(1, "b B c")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 2"), items), (docs, items.filter("item_id = 2"))):
        assert lexical.search(d, i).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(result.fetchall()) and rows


def test_bisection_puts_like_rows_together():
    rng = np.random.default_rng(1)
    group = rng.integers(8, size=800)
    rows = [np.unique(rng.integers(30, size=12) + 30 * g) for g in group]
    starts = np.cumsum([len(r) for r in rows]) - [len(r) for r in rows]
    weights, biases = tree(np.concatenate(rows), starts, 240, 3)
    leaf = routed(weights, biases, np.concatenate(rows), starts)
    assert leaf.max() == 7 and np.bincount(leaf, minlength=8).min() > 0
    assert sum(np.bincount(leaf[group == g]).max() for g in range(8)) > 0.9 * 800

"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from lumenprice.plans import interpret, matching, pages, registry, relational, scalar, searching, sheets  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no input tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in found.collect()]
    if name not in registry.SQL:
        assert rows
        return
    result = con.execute(registry.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    names = sorted(columns)
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(dict(zip(columns, r))[n]) for n in names) for r in result.fetchall())

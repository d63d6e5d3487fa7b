"""The fuzzy index and the pivots' blocks against all pairs, versions in batches, the search index."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenprice.operators import blocks, fuzzy, neighbours, resolve, search, versioning
from lumenprice.operators.similarity import ratio, sorted_tokens


def names(rng, n):
    parts = ["".join(rng.choice("абвгдежзиклмнопрстуф") for _ in range(rng.randrange(3, 11))) for _ in range(200)]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"ROWS": 40, "QUERIES": 16, "LEAST": 8}.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(neighbours, "LEAST", 8)


@pytest.mark.parametrize("k", [5, 40])
def test_no_entry_is_lost(spark, small, k):
    rng = random.Random(k)
    entries = names(rng, 600)
    entries += entries[:150]  # entries with several owners
    rows = [(e, i, i % 2) for i, e in enumerate(entries)]
    asked = [e[:3] + e[4:] for e in entries[:60]] + names(rng, 20) + ["", "ъъъ", entries[3]]
    found = fuzzy.nearest_entries(spark.createDataFrame([(a,) for a in asked], "entry_of string"), spark.createDataFrame(rows, "entry string, service_id long, seq int"), k).collect()
    want = []
    for a in set(asked):
        rated = sorted((-ratio(sorted_tokens(a), sorted_tokens(e)), i, n, e) for e, i, n in rows)[:k]
        want += [(a, i, n, e, -ts) for ts, i, n, e in rated]
    assert sorted(map(tuple, found)) == sorted(want)


def test_few_pairs_are_compared(spark, small):
    """Of a catalogue of some 9000 names each misspelt one is compared with under a tenth."""
    rng = random.Random(1)
    entries = sorted(set(names(rng, 10_000)))
    index, _ = fuzzy.index(spark.createDataFrame([(e, i, 0) for i, e in enumerate(entries)], "entry string, service_id long, seq int"), 5)
    asked = [e[:3] + e[4:] for e in entries[::400]]
    tried = 0
    packs = [r.asDict() | {"entry": asked, "ats": list(range(len(asked)))} for r in index.collect()]
    limits = [fuzzy.bounds(p) for p in packs]
    for i in range(len(asked)):
        least, found = -1.0, []
        for p, most in sorted(zip(packs, limits), key=lambda x: -x[1][i]):
            if most[i] >= least:
                hits = fuzzy.within(p, [(i, least)], 5)
                tried += hits[0][-1]
                found = sorted(found + [h[2] for h in hits if h[1]])[-5:]
                least = found[0] if len(found) == 5 else least
    assert tried < 0.1 * len(asked) * len(entries)


def test_neighbours(spark, small):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    v = [(i, (centres[i % 12] + 0.15 * rng.normal(size=8)).tolist()) for i in range(900)]
    v += [(900, v[3][1]), (901, None), (902, [0.0] * 8), (903, []), (904, [None] + [1.0] * 7)]
    rows = spark.createDataFrame(v, "id long, embedding array<double>").repartition(4)
    known = [(i, np.array(x) / np.linalg.norm(x)) for i, x in v if i <= 900]
    want = {}
    for i, x in known:
        if i % 50 == 0:
            want[i] = sorted(((-float(x @ y), j) for j, y in known if j != i))[:7]
    found: dict = {}
    for r in neighbours.nearest(rows.filter("id % 50 = 0"), rows, 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert found.keys() == want.keys()
    for i, own in found.items():
        assert [r for r, _, _ in sorted(own)] == list(range(7)) and [s for _, _, s in sorted(own)] == pytest.approx([max(0, -s) for s, _ in want[i]])
        assert {j for _, j, _ in own} == {j for _, j in want[i]}
    packs = [r.asDict() | {"v": [known[0][1].tobytes()]} for r in neighbours.around(neighbours.unit(rows)).collect()]
    near = -want[0][-1][0]
    met = sum(len(p["ids"]) for p in packs if neighbours.bounds(p)[0] >= 1 + near)
    assert met < 0.3 * len(known)  # one group of twelve and what lies beside it
    assert neighbours.nearest(rows.limit(0), rows, 3).count() == neighbours.nearest(rows, rows.limit(0), 3).count() == 0


KIND = "partner_id int, service_id int, item_id string, price_resident decimal(14,2), price_nonresident decimal(14,2), price_original decimal(14,2), effective_date date, seq int"


def price_rows(n):
    rng = random.Random(9)
    day = lambda: rng.choice([None, *[date(2024, 1, x) for x in (1, 2, 3, 4)]])
    return [(k, None if k == 6 else k, f"i{i}", *rng.choice([(p, None, None), (None, p, None), (None, None, p)]), day(), i) for i in range(n) for k, p in [(rng.randint(0, 6), Decimal(rng.choice(["100.00", "120.00", "151.00", "300.00"])))]]


@pytest.mark.parametrize("cuts", [[], [40], [10, 11, 90]])
def test_versions_in_batches(spark, tmp_path, cuts):
    """Any split gives the table of one run, and folders of other keys aren't written again."""
    rows, path = price_rows(140), str(tmp_path / "versions")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        versioning.merge_into(spark, path, spark.createDataFrame(rows[a:b], KIND))
    found = {r["item_id"]: (r["is_active"], r["supersedes"], r["is_anomaly"]) for r in versioning.table_of(spark, path).collect()}
    whole = versioning.versions(spark.createDataFrame(rows, KIND)).collect()
    want = {r["item_id"]: (r["is_current"], r["supersedes"], r["is_jump"]) for r in whole} | {r[2]: (True, None, False) for r in rows if r[1] is None}
    assert found == want and any(w[2] for w in want.values())
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "versions").rglob("*.parquet")}
    versioning.merge_into(spark, path, spark.createDataFrame([(3, 3, "new", Decimal("1.00"), None, None, date(2025, 1, 1), 500)], KIND))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "versions").rglob("*.parquet")}
    assert len({p.parent for p in before.keys() - after.keys()}) == 1 and len(after) >= len(before)


def test_settled_versions_are_not_written_again(spark, tmp_path):
    """A batch that touches all keys leaves the files of rows that nothing can change any more as they are."""
    rows, path = price_rows(200), str(tmp_path / "versions")
    versioning.merge_into(spark, path, spark.createDataFrame(rows[:100], KIND))
    settled = versioning.table_of(spark, path).filter("not is_active or service_id is null").count()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "versions").rglob("*.parquet")}
    versioning.merge_into(spark, path, spark.createDataFrame(rows[100:], KIND))
    kept = [str(p) for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert settled > 50 and sum(spark.read.parquet(p).count() for p in kept) == settled
    assert versioning.table_of(spark, path).count() == 200


def test_several_active_rows(spark):
    """Each row replaces the latest active one only; a row without a date is behind all that have one."""
    price = Decimal("100.00")
    old = [(1, 1, f"o{i}", price, None, None, d, i, True, None, False) for i, d in enumerate([date(2024, 1, 5), date(2024, 1, 3), None])]
    active = spark.createDataFrame(old, KIND + ", is_active boolean, supersedes string, is_anomaly boolean")
    batch = [("n1", None, "100.00"), ("n2", date(2024, 1, 2), "400.00"), ("n3", date(2024, 1, 4), "100.00")]
    rows = spark.createDataFrame([(1, 1, i, Decimal(p), None, None, d, 10 + n) for n, (i, d, p) in enumerate(batch)], KIND)
    found = {r["item_id"]: (r["is_active"], r["supersedes"], r["is_anomaly"]) for r in versioning.merged(active, rows).collect()}
    assert found == {"o0": (False, None, False), "n1": (True, "o0", False), "n2": (False, "o1", False), "n3": (True, "o1", False), "o1": (False, None, True), "o2": (True, None, False)}


def test_search_index(spark, tmp_path):
    services = spark.createDataFrame([(1, "Общий анализ крови", "лаб", True), (2, "Анализы мочи, анализ", "лаб", True), (3, "Прием терапевта", "врач", True), (4, "Анализ закрыт", "лаб", False), (5, None, None, True), (6, "100%_й анализ", None, True), (7, "", "x", True)], "service_id long, service_name string, category string, is_active boolean")
    partners = spark.createDataFrame([(1, "Анализ Плюс", "Алматы", True)], "partner_id long, name string, city string, is_active boolean")
    path = str(tmp_path / "index")
    search.build(search.titles(services, partners), path)
    look = lambda q: {(r["kind"], r["id"]): r["rank"] for r in search.lookup(spark, path, q).collect()}
    assert look("анализов") == {("service", 1): 0.1, ("service", 2): 0.2, ("service", 6): 0.1, ("partner", 1): 0.1}
    assert look("анализ КРОВЬ") == {("service", 1): 0.2} and look("терап") == {("service", 3): 0.0}
    assert look("на") == {} | {k: 0.0 for k in [("service", 1), ("service", 2), ("service", 6), ("partner", 1)]}  # a stop word is left to the pattern
    assert look("  ") == {} and look("нет такого") == {} and look("100%й") == {("service", 6): 0.0} and look("п_и") == {("service", 3): 0.0}
    plan = search.lookup(spark, path, "анализов")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan

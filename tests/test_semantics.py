"""Golden values of the scalar contracts, matching, versions and geometry."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenprice.functions import money, text
from lumenprice.operators import catalog, geometry, readmodel, resolve, search, similarity, versioning


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_parse_amount(spark):
    cases = {"16 600": "16600", "9000 тг": "9000", "14 400,00": "14400", "1 234 567": "1234567", "16 600": "16600", "": None, "слова": None, "0": None, "-500": "500", "14.400,00": "14400", "5,000.50": "5.0005", "1.234.567": "1234567", "12.500": "12.5"}
    assert column(spark, list(cases), money.parse_amount) == [None if v is None else Decimal(v) for v in cases.values()]


def test_labels_and_codes(spark):
    assert column(spark, ["резидентов", "нерезидентов", "дальнее зарубежье", "страховые", "Стоимость", None], money.classify_label) == ["resident", "nonresident", "nonresident", "insurance", "other", "other"]
    assert column(spark, ["  ОАК ", "Ёж, ёж", "д.м.н.", None], text.normalize) == ["общий анализ крови", "еж еж", "доктор медицинских наук", ""]
    assert column(spark, [" в02.110 ", "", None], text.normalize_code) == ["B02.110", None, None]


def test_fx_and_status(spark):
    rows = spark.createDataFrame([(Decimal("100.00"), "USD"), (Decimal("0.03"), "USD"), (Decimal("5.00"), "RUB"), (None, "USD")], "a decimal(14,2), c string")
    assert [r[0] for r in rows.select(money.convert_to_kzt(F.col("a"), F.col("c"))).collect()] == [Decimal("47500.00"), Decimal("14.25"), Decimal("5.00"), None]
    with pytest.raises(ValueError):
        readmodel.page(rows, [F.col("a")], 501)


@given(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs_is_the_textbook_one(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    assert similarity.lcs_length(a, b) == row[-1]


def test_similarities():
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.ratio("", "a") == 0


def fold(rows):
    """The contract row by row: [(key, item, price, date)] in order."""
    active, state, jumps = {}, {}, set()
    for key, item, price, when in rows:
        prev = active.get(key)
        if prev is None:
            active[key] = (item, price, when)
            state[item] = None
            continue
        newer = when >= prev[2] if when and prev[2] else True
        old, new = (prev[1], price) if newer else (price, prev[1])
        if old and abs(new - old) / old > Decimal("0.5"):
            jumps.add(item if newer else prev[0])
        state[item] = prev[0]
        if newer:
            active[key] = (item, price, when)
    return {v[0] for v in active.values()}, state, jumps


def test_versions_match_the_fold(spark):
    import random

    random.seed(4)
    rows = [(random.randint(0, 6), f"i{i}", Decimal(random.choice(["100.00", "120.00", "150.00", "151.00", "300.00"])), random.choice([None, *[date(2024, 1, x) for x in (1, 2, 3, 4)]])) for i in range(120)]
    frame = spark.createDataFrame([(k, k, i, p, None, d, n) for n, (k, i, p, d) in enumerate(rows)], "partner_id int, service_id int, item_id string, price_resident decimal(14,2), price_nonresident decimal(14,2), effective_date date, seq int")
    found = versioning.versions(frame).collect()
    active, state, jumps = fold(rows)
    assert {r["item_id"] for r in found if r["is_current"]} == active
    assert {r["item_id"]: r["supersedes"] for r in found} == state
    assert {r["item_id"] for r in found if r["is_jump"]} == jumps


def test_cascade_levels(spark):
    services = spark.createDataFrame([(1, "Глюкоза крови", "A1", True), (2, "Прием терапевта первичный", "B2", True), (3, "УЗИ почек", "C3", True), (4, "УЗИ печени", "C3", True), (5, "Архив", "D4", False)], "service_id long, service_name string, icd_code string, is_active boolean")
    items = spark.createDataFrame([("a", "что угодно", "а1"), ("b", "глюкоза  КРОВИ", None), ("c", "прием терапевта первичны", "zz"), ("d", "узи печени", "С3"), ("e", "совсем иное", None)], "item_id string, name string, code string")
    found = {r["item_id"]: (r["service_id"], r["method"]) for r in resolve.cascade(items, services).collect()}
    assert found["a"] == (1, "code") and found["b"] == (1, "exact") and found["c"] == (2, "fuzzy") and found["d"] == (4, "code") and found["e"][0] is None


def test_stitching():
    row = lambda top, name="", code="", price="", boundary=False: {"top": top, "name": name, "code": code, "price": price, "boundary": boundary, "anchor": bool(price) and not name}
    below = geometry.stitch([row(0, "", "", "100"), row(10, "Общий анализ", "A1"), row(20, "крови"), row(30, "Другая", "", "5")], 15)
    assert [r["name"] for r in below] == ["Общий анализ крови", "Другая"]
    gap = geometry.stitch([row(0, "", "", "100"), row(40, "Далеко")], 15)
    assert [r["name"] for r in gap] == ["", "Далеко"]
    capital = geometry.stitch([row(0, "", "", "100"), row(10, "Имя целое"), row(20, "Следующее")], 15)
    assert [r["name"] for r in capital] == ["Имя целое", "Следующее"]
    code = geometry.stitch([row(0, "", "K1", "100"), row(10, "имя", "K2")], 15)
    assert len(code) == 2


def test_stitching_shares_runs(spark):
    rows = [(1, 1, i, 10.0 * i, n, c, p, 15.0) for i, (n, c, p) in enumerate([
        ("", "A1", "100"), ("Анализ", None, None), ("крови (общий,", None, None), ("Развернутый)", None, None), ("Мазок", "B2", None), ("из зева", None, None), ("2.", None, "200"),
        ("ГОРМОНЫ КРОВИ", None, None), ("7)", None, "300"), ("Тестостерон", None, None), ("свободный", "C3", ""), ("Прием", "D4", "400"), ("ночной", "E5", None),
    ])]
    cells = spark.createDataFrame(rows, "doc_id long, page int, line int, top double, name string, code string, price string, gap double")
    found = [(r["name"], r["code"], r["price"]) for r in geometry.stitch_rows(cells, indexed=True).orderBy("line").collect()]
    assert found == [
        ("Анализ крови (общий, Развернутый)", "A1", "100"), ("Мазок из зева", "B2", "200"), ("ГОРМОНЫ КРОВИ", "", ""), ("Тестостерон свободный", "C3", "300"), ("Прием", "D4", "400"), ("ночной", "E5", ""),
    ]
    assert geometry.stitch_rows(cells).count() == 10  # a row number is a name here


def test_new_partners_in_order(spark):
    kind = "seq int, name string, bin string"
    rows = spark.createDataFrame([(1, "ТОО А", "1"), (2, "Б", "1"), (3, "Б", None), (4, "а", "9"), (5, "В", "9"), (6, "Г", "7"), (7, "Г", "8"), (8, "Д", "8")], kind)
    known = spark.createDataFrame([(0, "г", None)], kind)
    assert sorted(r["seq"] for r in catalog.new_partners(rows, known).collect()) == [1, 3, 5, 8]


def test_stems():
    assert search.stem("консультация") == search.stem("консультации") and search.stem("анализы") == search.stem("анализов") and search.stem("blood") == "blood"

"""Runs that go on from what is there: the registry of a stream, the arbiter's cache, matching again, documents apart, merged cells."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenprice.operators import arbiter, process, rematch, resolve, sheets
from lumenprice.sources import files
from lumenprice.streaming.ingest import ingest_new
from tests.test_sources import W, packed


def test_registry_over_a_restart(spark, tmp_path):
    folder, taken, skipped = tmp_path / "in", [], []
    folder.mkdir()

    def put(**contents):
        for name, content in contents.items():
            (folder / name.replace("__", ".")).write_bytes(content)

    def run():
        taken.clear()
        skipped.clear()
        take = lambda rows: taken.extend((r["name"], bytes(r["content"])) for r in rows.collect())
        skip = lambda rows: skipped.extend((r["name"], r["original"].rsplit("/", 1)[-1]) for r in rows.collect())
        ingest_new(spark, str(folder), str(tmp_path / "state"), take, skip).awaitTermination()
        return sorted(taken), sorted(skipped)

    put(a__xlsx=b"one", b__PDF=b"one", c__docx=b"two", d__txt=b"three", прайс__xls=b"four")
    assert run() == ([("a.xlsx", b"one"), ("c.docx", b"two"), ("прайс.xls", b"four")], [("b.PDF", "a.xlsx")])
    put(e__xlsx=b"two", f__xlsx=b"five", **{"g [1]{x}__xlsx": b"six"})
    assert run() == ([("f.xlsx", b"five"), ("g [1]{x}.xlsx", b"six")], [("e.xlsx", "c.docx")])
    assert run() == ([], [])


SERVICES = "service_id long, service_name string, icd_code string, is_active boolean"


def names(rng, n):
    words = ["анализ", "крови", "общий", "прием", "врача", "узи", "почек", "печени", "осмотр", "снимок", "детский", "повторный", "первичный", "биохимия", "мочи", "глюкоза"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def test_arbiter_is_asked_once(spark, tmp_path):
    rng = random.Random(2)
    services = spark.createDataFrame([(i, n, None, True) for i, n in enumerate(names(rng, 60))], SERVICES)
    asked_names = spark.createDataFrame([(n[1:-3] + "ъ",) for n in names(rng, 40)], "name string")
    asked = arbiter.questions(resolve.pooled(asked_names, services), services, "m").cache()
    rows = asked.collect()
    assert rows and all(len(r["candidates"]) == 5 for r in rows) and len({r["cache_key"] for r in rows}) == len(rows)
    log, path, bad = tmp_path / "log", str(tmp_path / "answers"), rows[0]["name"]
    log.mkdir()

    def ask(questions, failing=True):
        (log / str(random.random())).write_text("\n".join(q["name"] for q in questions))
        if failing and any(q["name"] == bad for q in questions):
            raise ConnectionError("the provider is away")
        return [{"choice": 2, "confidence": 0.9} if len(q["name"]) % 2 else None for q in questions]

    def counted():
        return Counter(n for f in log.iterdir() for n in f.read_text().split("\n"))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(arbiter, "CALL", 1)
        patch.setattr(arbiter, "ROUND", 7)
        first = arbiter.warm(asked.unionByName(asked), path, ask)
        answered = {r["name"] for r in rows if len(r["name"]) % 2}
        assert counted() == Counter(r["name"] for r in rows) and first == len(answered - {bad})
        arbiter.warm(asked, path, lambda q: ask(q, False))
        assert all(counted()[n] == 1 for n in answered - {bad}) and counted()[bad] == 2
    known = arbiter.verdicts(asked, arbiter.cached(spark, path))
    assert {r["name"] for r in known.collect()} == answered
    items = asked_names.distinct().withColumn("item_id", F.col("name")).withColumn("code", F.lit(None).cast("string"))
    found = {r["item_id"]: r for r in resolve.cascade(items, services, verdicts=known).collect()}
    assert all(found[n]["method"] == "llm" and found[n]["arbiter"] == "yes" and found[n]["score"] >= 0.9 for n in answered)


def test_cascade_with_all_providers(spark):
    """The levels in order: reranked scores can end an item, and the arbiter chooses by the reranked order."""
    services = spark.createDataFrame([(1, "алло", None, True), (2, "бокс", None, True), (3, "винт", None, True)], SERVICES)
    items = spark.createDataFrame([(n, n, None) for n in ("эээ", "ююю", "яяя", "щщщ", "бокс")], "item_id string, name string, code string")
    semantic = spark.createDataFrame([(n, s, 0.5 - s / 100) for n in ("эээ", "ююю", "яяя") for s in (1, 2, 3)], "name string, service_id long, score double")
    reranked = spark.createDataFrame([("эээ", 3, 0.9), ("ююю", 2, 0.6), ("щщщ", 1, 0.99)], "name string, service_id long, score double")
    verdicts = spark.createDataFrame([("ююю", 2, 0.7), ("яяя", 9, 0.7)], "name string, choice int, confidence double")
    found = {r["item_id"]: (r["service_id"], round(r["score"], 6), r["method"], r["arbiter"]) for r in resolve.cascade(items, services, semantic, verdicts, reranked).collect()}
    assert found["эээ"] == (3, 0.9, "rerank", None) and found["бокс"] == (2, 1.0, "exact", None)
    assert found["ююю"] == (1, 0.7, "llm", "yes")  # the second choice behind the reranked first
    assert found["яяя"] == (None, 0.49, "none", "no") and found["щщщ"][0] is None and found["щщщ"][2] == "none"


def test_rematch_equals_a_full_run(spark):
    rng = random.Random(6)
    rows = [(i, n, f"A{i % 25}" if i % 3 else None, i % 11 > 0) for i, n in enumerate(names(rng, 120))]
    old = spark.createDataFrame(rows, SERVICES)
    later = [r for r in rows if r[0] not in (4, 5)] + [(500, "узи почек детский", "A3", True), (501, "совсем новая услуга", "Z9", True)]
    later = [(i, n + " новый" if i == 20 else n, "Q1" if i == 31 else c, not a if i == 44 else a) for i, n, c, a in later]
    new = spark.createDataFrame(later, SERVICES)
    asked = [(f"i{i}", n if i % 4 else n[1:], f"A{i % 30}" if i % 5 == 0 else None) for i, n in enumerate(names(rng, 150))]
    before = spark.createDataFrame(asked, "item_id string, name string, code string")
    items = spark.createDataFrame([r for r in asked if r[0] != "i7"] + [("new", "узи почек", None)], "item_id string, name string, code string")
    outcomes, near = resolve.cascade(before, old).cache(), rematch.nearest(before, old).cache()
    found = rematch.rematch(items, before, outcomes, near, old, new).collect()
    whole = resolve.cascade(items, new).collect()
    assert sorted(map(str, found)) == sorted(map(str, whole))
    again = rematch.touched(items, before, near, old, old)
    assert [r["item_id"] for r in again.collect()] == ["new"]


def cells(*rows):
    return [(doc, page, i, j, v) for doc, page, i, values in rows for j, v in enumerate(values) if v]


CELL = "doc_id long, page int, row int, column int, value string"


def test_workbooks(spark):
    head = ["№", "Наименование услуги", "Цена"]
    rows = cells(
        (1, 0, 31, head), (1, 0, 32, ["", "ТЕРАПИЯ"]), (1, 0, 33, ["1", "Прием", "500"]), (1, 1, 1, head), (1, 1, 2, ["1", "УЗИ", "700"]),
        (2, 0, 41, head), (2, 0, 42, ["1", "Прием", "500"]),
        (3, 0, 2, ["", "Код по тарификатору", "Услуга", ""]), (3, 0, 1, ["", "Цены на услуги"]), (3, 0, 3, ["", "Цена", "", "для граждан РК"]), (3, 0, 4, ["x", "A1", "Прием", "900"]),
    )
    found = [(r["doc_id"], r["page"], r["row"], r["name"], r["code"], r["category"], [(p["label"], int(p["amount"])) for p in r["prices"]]) for r in sheets.workbook_items(spark.createDataFrame(rows, CELL)).collect()]
    assert sorted(found) == [
        (1, 0, 33, "Прием", None, "ТЕРАПИЯ", [("Цена", 500)]), (1, 1, 2, "УЗИ", None, None, [("Цена", 700)]),
        (3, 0, 4, "Прием", "A1", None, [("для граждан РК", 900)]),
    ]


def test_merged_cells(spark):
    cell = lambda text, span=1, merge=None: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>' + (f'<w:vMerge w:val="{merge}"/>' if merge == "restart" else "<w:vMerge/>" if merge else "") + f"</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [[cell("Код"), cell("Наименование"), cell("Цена", 2)], [cell("Раздел 2. Анализы", 4)], [cell("B1", merge="restart"), cell("Прием"), cell("за час"), cell("500")], [cell("", merge="on"), cell("Осмотр", 2), cell("700")]]
    table = f'<w:document {W}><w:body><w:tbl>{"".join("<w:tr>" + "".join(r) + "</w:tr>" for r in rows)}</w:tbl></w:body></w:document>'
    frame = spark.createDataFrame([("1", "docx", bytearray(packed(**{"word/document.xml": table})))], "path string, file_format string, content binary")
    found, _ = files.cells(frame)
    own = found.selectExpr("cast(path as long) as doc_id", "sheet as page", "row", "column", "value")
    assert {(r["row"], r["column"]): r["value"] for r in own.filter("row > 2").collect()} == {(3, 0): "B1", (3, 1): "Прием", (3, 2): "за час", (3, 3): "500", (4, 0): "B1", (4, 1): "Осмотр", (4, 2): "Осмотр", (4, 3): "700"}
    items = [(r["row"], r["name"], r["code"], r["category"], [int(p["amount"]) for p in r["prices"]]) for r in process.extracted(own, "docx").orderBy("row").collect()]
    assert items == [(3, "Прием", "B1", "Анализы", [500]), (4, "Осмотр", "B1", "Анализы", [700])]


def test_documents_fail_alone(spark):
    from datetime import date

    good = cells((1, 0, 1, ["Наименование услуги", "Цена"]), (1, 0, 2, ["Прием", "500"]), (1, 0, 3, ["", "700"]))
    rows = good + [(2, None, 1, 0, "x"), (3, 0, -1, 0, "x"), *[(4, *r[1:]) for r in good], (4, 0, 2, 0, "Другое"), *[(5, *r[1:]) for r in good]]
    docs = spark.createDataFrame([(i, 7, date(2024, i, 1), "KZT", date(2025, 1, 1)) for i in range(1, 7)], "doc_id long, partner_id long, effective_date date, currency string, today date")
    taken, status = process.process(spark.createDataFrame(rows, CELL), docs, spark.createDataFrame([(1, "Прием", None, True)], SERVICES))
    assert sorted((r["doc_id"], r["row"], r["service_id"]) for r in taken.collect()) == [(1, 2, 1), (5, 2, 1)]
    found = {r["doc_id"]: (r["parse_status"], r["log"]) for r in status.collect()}
    assert [found[i][0] for i in range(1, 7)] == ["done", "error", "error", "error", "done", "error"]
    assert "without a place" in found[2][1] and "negative" in found[3][1] and "two values" in found[4][1] and found[1][1].startswith("Извлечено 1")

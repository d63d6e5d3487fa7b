"""From cells to versioned prices, and catalogues under other names."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

from lumenprice.operators import process, tables
from lumenprice.sources import catalogs, files
from tests.test_sources import packed

LISTS = (
    [["Прайс-лист", "", "", ""], ["№ п/п", "Код услуги", "Наименование услуги", "Цена резидент"], ["", "", "ТЕРАПИЯ", ""], ["1", "A1.1", "Прием терапевта", "5000"], ["2", "A1.2", "Осмотр", "700 тг"], ["", "", "Итого", "5700"], ["3", "", "Неизвестная", "нет"]],
    [["№", "Код услуги", "Наименование услуги", "Цена резидент"], ["1", "A1.1", "Прием терапевта", "9000"], ["2", "", "Совсем другое", "100"], ["3", "A1.2", "Осмотр", "710"]],
)
COLUMN = "ABCD"


def workbook(rows: list[list[str]]) -> bytes:
    cell = lambda i, j, v: f'<c r="{COLUMN[j]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows))
    return packed(**{"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>'})


def test_files_to_versions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(str(i + 1), "xlsx", bytearray(workbook(t))) for i, t in enumerate(LISTS)] + [("3", "xlsx", bytearray(b"broken"))]
    found, warned = files.cells(spark.createDataFrame(rows, "path string, file_format string, content binary"))
    assert [r["path"] for r in warned.collect()] == ["3"]
    cells = found.selectExpr("cast(path as long) as doc_id", "sheet as page", "row", "column", "value")
    docs = spark.createDataFrame([(i, 7, date(2024, i, 1), "KZT", date(2025, 1, 1)) for i in (1, 2, 3)], "doc_id long, partner_id long, effective_date date, currency string, today date")
    services = spark.createDataFrame([(1, "Прием терапевта", "A1.1", True), (2, "Осмотр врача", "A1.2", True)], "service_id long, service_name string, icd_code string, is_active boolean")
    taken, status = process.process(cells, docs, services)
    got = {(r["doc_id"], r["row"]): r for r in taken.collect()}
    assert sorted(got) == [(1, 4), (1, 5), (2, 2), (2, 3), (2, 4)]
    assert [got[k]["service_id"] for k in sorted(got)] == [1, 2, 1, None, 2]
    assert [got[k]["is_current"] for k in sorted(got)] == [False, False, True, True, True]
    assert got[1, 4]["category"] == "ТЕРАПИЯ" and got[1, 5]["price_resident"] == Decimal("700.00") and got[1, 4]["code"] == "A1.1"
    assert got[2, 2]["is_jump"] and got[2, 2]["needs_review"] and not got[2, 4]["is_jump"] and not got[1, 4]["needs_review"]
    assert {r["doc_id"]: (r["items"], r["review"], r["parse_status"]) for r in status.collect()} == {1: (2, 0, "done"), 2: (3, 2, "needs_review"), 3: (0, 0, "error")}


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "doc_id long, page int, row int, column int, value string")
    below, header = process.grid(cells)
    assert tables.items(below, tables.table_roles(below, header)).count() == 0


def test_catalogs(spark, tmp_path):
    assert catalogs.fields(["Код", " Name ", "НАИМЕНОВАНИЕ", "x", "name"]) == {"service_name": " Name ", "category": None, "icd_code": "Код", "synonyms": None}
    want = [("УЗИ", None, "1", ["a", "b"])]
    for name, content in (("list", [{"Услуга": "УЗИ", "МКБ": "1", "синонимы": "a; b;"}]), ("object", {"services": [{"Услуга": "УЗИ", "МКБ": "1", "синонимы": ["a", "b"]}]})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content), "utf-8")
        assert [tuple(r) for r in catalogs.read_json(spark, str(path)).collect()] == want
    cells = spark.createDataFrame([(0, 1, 0, "Услуга "), (0, 1, 2, "Код"), (0, 2, 0, "УЗИ"), (0, 2, 2, "1"), (1, 1, 0, "x")], "sheet int, row int, column int, value string")
    assert [tuple(r) for r in catalogs.from_cells(cells).collect()] == [("УЗИ", None, "1", None)]

"""Decoding of workbooks, documents and archives, and the streaming ingest."""

from __future__ import annotations

import io
import zipfile

from lumenprice.sources import files
from lumenprice.streaming.ingest import ingest

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5000</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>Цена</t></is></c></row></sheetData></worksheet>'
STRINGS = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Прием</t></si></sst>'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f'<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:ins><w:r><w:t>Имя</w:t></w:r></w:ins><w:del><w:r><w:t>Старое</w:t></w:r></w:del></w:p></w:tc><w:tc><w:p><w:r><w:t>700</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def packed(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


XLSX = packed(**{"xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": STRINGS})
DOCX = packed(**{"word/document.xml": DOC})


def test_cells(spark):
    rows = spark.createDataFrame([("a", "xlsx", bytearray(XLSX)), ("b", "docx", bytearray(DOCX)), ("c", "xlsx", bytearray(b"broken")), ("d", "xls", bytearray(b""))], "path string, file_format string, content binary")
    cells, warnings = files.cells(rows)
    assert {tuple(r) for r in cells.collect()} == {("a", 0, 1, 0, "Прием"), ("a", 0, 1, 2, "5000"), ("a", 0, 2, 1, "Цена"), ("b", 0, 1, 0, "Имя"), ("b", 0, 1, 1, "700")}
    assert {r["path"] for r in warnings.collect()} == {"c", "d"}


def test_unzip(spark):
    rows = spark.createDataFrame([("z", bytearray(packed(**{"dir/прайс.xlsx": "x", "b.pdf": "y"}))), ("bad", bytearray(b"no"))], "path string, content binary")
    assert {(r["path"], r["name"], bytes(r["content"])) for r in files.unzip(rows).collect()} == {("z", "прайс.xlsx", b"x"), ("z", "b.pdf", b"y")}


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(XLSX)

    def process(batch):
        seen.extend((r["name"], r["file_format"]) for r in batch.select("name", "file_format").collect())

    ingest(spark, str(folder), str(tmp_path / "ck"), process).awaitTermination(120)
    (folder / "b.pdf").write_bytes(b"%PDF-1.4")
    ingest(spark, str(folder), str(tmp_path / "ck"), process).awaitTermination(120)
    assert sorted(seen) == [("a.xlsx", "xlsx"), ("b.pdf", "pdf")]
    assert files.read_files(spark, str(folder)).count() == 2

"""Price files as rows: format detection, archives, and workbooks and documents decoded to cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.functions.text import text_quality

# Fixed values of the contract: first bytes of the formats, and what is kept of dumps and names.
PDF, ZIP, OLE = "25504446", "504B0304", "D0CF11E0"
KEPT = {"sheet_dump": 500_000, "document_dump": 1_000_000, "log": 50_000, "raw_name": 2000}
CELLS = "path string, sheet int, row int, column int, value string"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == PDF, "pdf").when(head == ZIP, "zipxml").when(head == OLE, "ole")


def detect_format(name: Column, kind: Column) -> Column:
    """The format by extension and first bytes (magic); null where neither tells."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))
    return (
        F.when((ext == "pdf") | (kind == "pdf"), "pdf").when(ext.isin("docx", "xlsx", "xls"), ext).when(kind == "zipxml", "xlsx").when(kind == "ole", "xls")
    )


def kept(value: Column, what: str) -> Column:
    """As much of a text as the contract keeps of this kind (KEPT)."""
    return F.substring(value, 1, KEPT[what])


def classify_pdf(pages: DataFrame, first: int = 3) -> DataFrame:
    """doc_id, file_format of PDF pages (doc_id, page from 1, text): scan_pdf where the first pages' text can't be read."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    texts = pages.filter(F.col("page") <= first).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    return texts.select("doc_id", F.when(text_quality(F.col("text"))["is_corrupt"], "scan_pdf").otherwise("pdf").alias("file_format"))


def effective_date(name: Column, text: Column) -> Column:
    """A full date in the name, else January 1 of its first year, else of the first year in the text's first 2000 characters."""
    day, month, year = (F.regexp_extract(name, r"([0-9]{1,2})[.\-_]([0-9]{1,2})[.\-_](20[0-9]{2})", i) for i in (1, 2, 3))
    full = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    first_year = lambda s: F.nullif(F.regexp_extract(s, "(20[0-9]{2})", 1), F.lit(""))
    by_year = F.coalesce(first_year(name), first_year(F.substring(text, 1, 2000)))
    return F.coalesce(F.when(year != "", full), F.try_to_date(F.concat(by_year, F.lit("-01-01")), "yyyy-MM-dd"))


def unzip(files: DataFrame) -> DataFrame:
    """path, name, content of the members of archives (path, content), by base name; broken archives give none."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                name = info.filename
                                if not info.flag_bits & 0x800:  # written without the UTF-8 mark
                                    try:
                                        name = name.encode("cp437").decode("utf-8")
                                    except UnicodeError:
                                        pass
                                out.append((path, re.split(r"[/\\]", name)[-1], z.read(info)))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, name string, content binary")


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def xlsx_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(sheet from 0, row from 1, column from 0, value) of a workbook's filled cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET + "si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for i, name in enumerate(sheets):
            try:
                root = ElementTree.fromstring(z.read(name))
            except ElementTree.ParseError:
                continue  # a broken sheet doesn't lose the others
            for cell in root.iter(SHEET + "c"):
                place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
                value = cell.find(SHEET + "v")
                text = "".join(t.text or "" for t in cell.iter(SHEET + "t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                if place and text:
                    column = 0
                    for c in place[1]:
                        column = column * 26 + ord(c) - 64
                    yield i, int(place[2]), column - 1, text


def docx_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table from 0, row from 1, column from 0, value) of a document's tables, tracked changes accepted.

    A merged cell's text stands in every column and row that it spans (gridSpan, vMerge), so that what is behind it keeps its column.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for parent in list(root.iter()):
        for child in [c for c in parent if c.tag == WORD + "del"]:
            parent.remove(child)

    def number(parent: ElementTree.Element | None, name: str, default: int) -> int:
        found = None if parent is None else parent.find(WORD + name)
        return default if found is None else int(found.get(WORD + "val", default))

    for i, found in enumerate(root.iter(WORD + "tbl")):
        above: dict[int, str] = {}
        for j, row in enumerate(found.findall(WORD + "tr")):
            here: dict[int, str] = {}
            k = number(row.find(WORD + "trPr"), "gridBefore", 0)
            for cell in row.findall(WORD + "tc"):
                style = cell.find(WORD + "tcPr")
                span = max(1, number(style, "gridSpan", 1))
                merge = None if style is None else style.find(WORD + "vMerge")
                if merge is not None and merge.get(WORD + "val", "continue") != "restart":
                    text = above.get(k, "")
                else:
                    text = " ".join("".join(t.text or "" for t in p.iter(WORD + "t")) for p in cell.iter(WORD + "p")).strip()
                here.update(dict.fromkeys(range(k, k + span), text))
                k += span
            for column, text in here.items():
                if text:
                    yield i, j + 1, column, text
            above = here


#: Decoders of file contents to cells, by format; more can be registered.
EXTRACTORS: dict[str, Callable[[bytes], Iterator[tuple[int, int, int, str]]]] = {"xlsx": xlsx_cells, "docx": docx_cells}


def register_extractor(file_format: str, decode: Callable[[bytes], Iterator[tuple[int, int, int, str]]]) -> None:
    EXTRACTORS[file_format] = decode


def cells(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of files (path, file_format, content), and a warning for each file that can't be decoded; one task a file."""
    known = dict(EXTRACTORS)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["file_format"], batch["content"]):
                try:
                    out += [(path, *cell, None) for cell in known[kind](content)]
                except Exception as e:  # any broken file is a warning, not the job's end
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "sheet", "row", "column", "value", "warning"])
            yield frame.astype({c: "Int32" for c in ("sheet", "row", "column")})

    found = files.select("path", "file_format", "content").mapInPandas(decode, CELLS + ", warning string")
    return found.filter("warning is null").drop("warning"), found.filter("warning is not null").select("path", "warning")

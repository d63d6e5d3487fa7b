"""Catalogues of services from JSON and workbooks, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.functions.text import split_synonyms

# Fixed values of the contract: what the fields are called, the first names first.
ALIASES = {
    "service_name": ("service_name", "name", "name_ru", "наименование", "услуга", "название"),
    "category": ("category", "категория", "раздел", "группа", "специальность"),
    "icd_code": ("icd_code", "icd", "мкб", "код", "tarificatrcode", "тарификатор", "код тарификатора"),
    "synonyms": ("synonyms", "синонимы", "synonym"),
}


def fields(columns: list[str]) -> dict[str, str | None]:
    """The column of each field: the first alias that a column has, and of such columns the first; blanks and case don't count."""
    at: dict[str, str] = {}
    for c in columns:
        at.setdefault(c.strip().lower(), c)
    return {field: next((at[a] for a in names if a in at), None) for field, names in ALIASES.items()}


def resolved(rows: DataFrame) -> DataFrame:
    """service_name, category, icd_code and synonyms (an array) of rows with columns of any names; fields without a column are null."""
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(f"`{c}`")
    found = {f: text(c) for f, c in fields(rows.columns).items()}
    kind = dict(rows.dtypes).get(fields(rows.columns)["synonyms"] or "", "string")
    found["synonyms"] = found["synonyms"] if kind.startswith("array") else split_synonyms(found["synonyms"].cast("string"))
    return rows.select(*[c.alias(f) for f, c in found.items()])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a JSON file: a list of services, or an object with one as services."""
    rows = spark.read.json(path, multiLine=True)
    return resolved(rows.select(F.explode("services").alias("s")).select("s.*") if "services" in rows.columns else rows)


def from_cells(cells: DataFrame) -> DataFrame:
    """The catalogue of a workbook's cells (sheet, row, column, value): the first sheet, named by its first row."""
    first = cells.filter("sheet = 0")
    header = {r["column"]: r["value"].strip() for r in first.filter("row = 1").collect()}  # one row of captions
    named = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(n) for c, n in sorted(header.items())]
    return resolved(first.filter("row > 1").groupBy("row").agg(*named))

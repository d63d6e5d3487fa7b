"""Queries of pages of words, made from the parts: from words to items of text pages and of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.operators import process
from lumenprice.plans import domain
from lumenprice.plans.registry import query

#: A list for every 30 parts with an item for each, on the page of its parity: a number, a name (of two lines where p % 7 = 0), a code and two prices; a section tops page 0.
BASE = """b AS (SELECT p_partkey // 30 AS doc_id, CAST(p_partkey % 30 AS INTEGER) AS line, p_partkey AS p, CAST(floor(p_retailprice) AS BIGINT) AS x FROM part)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words of columns at 20, 60, 300, 400 and 500 points; lines 30 points apart, the second line of a name 10 below its first."""
    base = domain.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 30).alias("doc_id"), (F.col("p_partkey") % 30).cast("int").alias("line"), F.col("p_partkey").alias("p"), F.floor("p_retailprice").cast("long").alias("x"))
    base = base.withColumns({"page": F.col("line") % 2, "y": F.col("line") * 40.0 + 140})
    word = lambda text, x0, y, width=40.0: F.struct((text if not isinstance(text, str) else F.lit(text)).cast("string").alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x0 + width)).alias("x1"), y.alias("top"), (y + 8.0).alias("bottom"))
    y, p = F.col("y"), F.col("p")
    whole = p % 7 != 0
    own = [
        word(F.floor(F.col("line") / 2) + 1, 20, y, 6.0), F.when(whole, word("Прием", 60, y)), F.when(whole, word("врача", 110, y)), F.when(whole, word(F.concat(F.lit("а"), p), 160, y)),
        F.when(~whole, word("Анализ", 60, y - 10.0)), F.when(~whole, word("крови", 110, y - 10.0)), F.when(~whole, word(F.concat(F.lit("из"), p), 60, y + 10.0)),
        F.when(p % 3 != 0, word(F.concat(F.lit("B1."), p), 300, y)), word(F.col("x"), 400, y, 30.0), F.when(p % 5 < 3, word(F.col("x") + 7, 500, y, 30.0)),
    ]
    pages = base.select("doc_id", "page").distinct().withColumn("y", F.lit(60.0))
    head = [word("Наименование", 60, y), word("услуги", 110, y), word("Код", 300, y, 20.0), word("Цена", 400, y, 30.0), word("Стоимость", 500, y, 30.0)]
    first = [F.when(F.col("page") == 0, word("ОТДЕЛЕНИЕ", 60, y + 30.0)), F.when(F.col("page") == 0, word(F.expr("substring('абвгдежзик', cast(doc_id % 10 as int) + 1, 1)"), 110, y + 30.0))]
    laid = lambda rows, cells: rows.select("doc_id", "page", F.inline(F.array_compact(F.array(*cells))))
    return laid(base, own).unionByName(laid(pages, [*head, *first]))


def _expected(carry: str) -> str:
    return f"""WITH {BASE}, t AS (SELECT *, line % 2 AS page FROM b WHERE doc_id IN (SELECT doc_id FROM b GROUP BY doc_id HAVING count(*) >= 20))
      SELECT doc_id, page, CASE WHEN p % 7 = 0 THEN 'Анализ крови из' || p ELSE 'Прием врача а' || p END AS name, CASE WHEN p % 3 <> 0 THEN 'B1.' || p END AS code, {carry} AS category,
        'Цена=' || x || CASE WHEN p % 5 < 3 THEN '|Стоимость=' || (x + 7) ELSE '' END AS prices FROM t"""


def _items(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Lists of twenty lines and more: pages of very few have too little to tell columns by."""
    own = words(spark, d)
    full = domain.table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 30).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").select("doc_id")
    found = process.word_items(own.join(full, "doc_id"), kind)
    prices = F.array_join(F.transform("prices", lambda p: F.concat(p["label"], F.lit("="), F.format_string("%.0f", p["amount"].cast("double")))), "|")
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "name", "code", "category", prices.alias("prices"))


@query(_expected("'ОТДЕЛЕНИЕ ' || substr('абвгдежзик', CAST(doc_id % 10 AS INTEGER) + 1, 1)"))
def page_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "pdf")


@query(_expected("CASE WHEN page = 0 THEN 'ОТДЕЛЕНИЕ ' || substr('абвгдежзик', CAST(doc_id % 10 AS INTEGER) + 1, 1) END"))
def scan_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "scan")

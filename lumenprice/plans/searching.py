"""Queries of the inverted index: its postings, searches by stems and by parts of titles."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.operators import search
from lumenprice.plans import domain
from lumenprice.plans.registry import query
from lumenprice.sources.stored import shared_dir

#: Russian forms (by the size of a part modulo 3) that stand for the words of the parts' names, and the stems of the published algorithm.
WORDS = {
    "large": (("большая", "больш"), ("большой", "больш"), ("большие", "больш")),
    "hot": (("горячая", "горяч"), ("горячей", "горяч"), ("горячие", "горяч")),
    "blue": (("синяя", "син"), ("синей", "син"), ("синие", "син")),
    "old": (("старая", "стар"), ("старой", "стар"), ("старые", "стар")),
    "cold": (("холодная", "холодн"), ("холодной", "холодн"), ("холодные", "холодн")),
    "red": (("красная", "красн"), ("красной", "красн"), ("красные", "красн")),
    "small": (("малая", "мал"), ("малой", "мал"), ("малые", "мал")),
    "new": (("новая", "нов"), ("новой", "нов"), ("новые", "нов")),
    "ring": (("консультация", "консультац"), ("консультации", "консультац"), ("консультаций", "консультац")),
    "bolt": (("анализ", "анализ"), ("анализа", "анализ"), ("анализов", "анализ")),
    "plate": (("операция", "операц"), ("операции", "операц"), ("операций", "операц")),
    "gear": (("прием", "при"), ("приема", "прием"), ("приемов", "прием")),
    "widget": (("осмотр", "осмотр"), ("осмотра", "осмотр"), ("осмотров", "осмотр")),
    "anvil": (("процедура", "процедур"), ("процедуры", "процедур"), ("процедур", "процедур")),
    "rod": (("снимок", "снимок"), ("снимка", "снимк"), ("снимков", "снимк")),
    "gizmo": (("укол", "укол"), ("укола", "укол"), ("уколов", "укол")),
}
_VALUES = ", ".join(f"('{word}', {form}, '{ru}', '{stem}')" for word, forms in WORDS.items() for form, (ru, stem) in enumerate(forms))
SQL = f"""WITH {domain.SQL}, words AS (SELECT * FROM (VALUES {_VALUES}) AS w(word, form, ru, stem)),
  parts AS (SELECT p_partkey AS id, p_size % 10 <> 0 AS is_active, p_type AS category, a.ru || ' ' || b.ru AS title, [a.stem, b.stem] AS stems FROM part
    JOIN words a ON a.word = split_part(p_name, ' ', 1) AND a.form = p_size % 3 JOIN words b ON b.word = split_part(p_name, ' ', 2) AND b.form = p_size % 3),
  t AS (SELECT 'service' AS kind, id, title, category, stems FROM parts WHERE is_active
    UNION ALL SELECT 'partner', partner_id, name, city, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') FROM partners WHERE is_active)"""


def services(spark: SparkSession, d: str) -> DataFrame:
    """The services of the catalogue under Russian names."""
    form = (F.col("p_size") % 3).cast("int")

    def russian(word):
        found = F.lit(None).cast("string")
        for name, forms in WORDS.items():
            found = F.when(word == name, F.get(F.array(*[F.lit(ru) for ru, _ in forms]), form)).otherwise(found)
        return found

    words = F.split("p_name", " ")
    name = F.concat_ws(" ", russian(words[0]), russian(words[1]))
    return domain.table(spark, d, "part").select(F.col("p_partkey").alias("service_id"), name.alias("service_name"), F.col("p_type").alias("category"), (F.col("p_size") % 10 != 0).alias("is_active"))


@functools.cache
def _index(application: str, spark: SparkSession, d: str) -> str:
    """Where the index of the tables in d is: it is written once and serves all later searches of the session."""
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    search.build(search.titles(services(spark, d), domain.partners(spark, d)), path)
    return path


def found(spark: SparkSession, d: str, text: str) -> DataFrame:
    return search.lookup(spark, _index(spark.sparkContext.applicationId, spark, d), text).withColumn("rank", F.col("rank").cast("decimal(6,2)"))


@query(f"{SQL}, s AS (SELECT kind, id, unnest(stems) AS stem FROM t) SELECT kind, id, 's:' || stem AS gram, count(*) AS weight FROM s GROUP BY ALL")
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = search.postings(search.titles(services(spark, d), domain.partners(spark, d)))
    return rows.filter(F.col("gram").startswith("s:")).select("kind", "id", "gram", "weight")


@query(f"{SQL} SELECT kind, id, title, category, CAST(0.2 AS DECIMAL(6,2)) AS rank FROM t WHERE list_contains(stems, 'красн') AND list_contains(stems, 'анализ')")
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "анализы красного")


@query(f"{SQL} SELECT kind, id, title, category, CAST(CASE WHEN list_contains(stems, 'снимк') THEN 0.1 ELSE 0 END AS DECIMAL(6,2)) AS rank FROM t WHERE list_contains(stems, 'снимк') OR title ILIKE '%снимку%'")
def search_one_stem(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "снимку")


@query(f"{SQL} SELECT kind, id, title, category, CAST(0 AS DECIMAL(6,2)) AS rank FROM t WHERE title ILIKE '%ЫЕ КО%'")
def search_part(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "ЫЕ КО")


@query(f"{SQL} SELECT kind, id, title, category, CAST(0 AS DECIMAL(6,2)) AS rank FROM t WHERE title ILIKE '%я_о%'")
def search_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "я_о")

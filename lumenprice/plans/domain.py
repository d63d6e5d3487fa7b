"""The price catalogue's tables as projections of the input tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"1-URGENT": "pdf", "2-HIGH": "docx", "3-MEDIUM": "xlsx", "4-NOT SPECIFIED": "xls", "5-LOW": "scan_pdf"}
STATUSES = {"F": "done", "O": "needs_review", "P": "pending"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, names: dict[str, str]):
    found = F.lit(None).cast("string")
    for k, v in names.items():
        found = F.when(F.col(column) == k, v).otherwise(found)
    return found


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey", "left").select(  # 25 nations
        F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("name"), "city", (F.col("s_acctbal") > 0).alias("is_active")
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("service_id"), F.col("p_name").alias("service_name"), F.col("p_type").alias("category"),
        F.concat("p_brand", F.lit("."), "p_size").alias("icd_code"), (F.col("p_size") % 10 != 0).alias("is_active"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("price_"), "o_orderkey", F.lit("."), _mapped("o_orderpriority", FORMATS)).alias("file_name"),
        _mapped("o_orderpriority", FORMATS).alias("file_format"), _mapped("o_orderstatus", STATUSES).alias("parse_status"),
        F.col("o_orderdate").cast("date").alias("effective_date"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") / 1000).cast("decimal(14,3)").alias("processing_seconds"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"),
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("partner_id"),
        F.col("l_partkey").alias("part_id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("service_id"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("price_resident"),
        F.when(F.col("l_tax") != 0, (F.col("l_extendedprice").cast("decimal(14,2)") + F.round(F.col("l_tax") * 10000).cast("int")).cast("decimal(14,2)")).alias("price_nonresident"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date")).alias("effective_date"),
        (F.col("l_linestatus") == "O").alias("is_active"), (F.col("l_discount") > 0.07).alias("needs_review"),
        (F.col("l_quantity") > 49).alias("is_anomaly"), (1 - F.col("l_discount")).cast("decimal(6,4)").alias("match_confidence"),
        _mapped("l_returnflag", {"A": "code", "R": "exact", "N": "none"}).alias("match_method"),
    )


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


#: The same tables for SQL, to be put after WITH.
SQL = f"""
partners AS (SELECT s_suppkey AS partner_id, s_name AS name, n_name AS city, s_acctbal > 0 AS is_active FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
services AS (SELECT p_partkey AS service_id, p_name AS service_name, p_type AS category, p_brand || '.' || p_size AS icd_code, p_size % 10 <> 0 AS is_active FROM part),
docs AS (SELECT o_orderkey AS doc_id, 'price_' || o_orderkey || '.' || {_case("o_orderpriority", FORMATS)} AS file_name, {_case("o_orderpriority", FORMATS)} AS file_format,
  {_case("o_orderstatus", STATUSES)} AS parse_status, CAST(o_orderdate AS DATE) AS effective_date, o_orderdate AS created_at, CAST(o_totalprice / 1000 AS DECIMAL(14,3)) AS processing_seconds FROM orders),
items AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id, l_orderkey AS doc_id, l_linenumber AS line, l_suppkey AS partner_id, l_partkey AS part_id,
  CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS service_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS price_resident,
  CASE WHEN l_tax <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(round(l_tax * 10000) AS INTEGER) AS DECIMAL(14,2)) END AS price_nonresident,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS effective_date, l_linestatus = 'O' AS is_active, l_discount > 0.07 AS needs_review,
  l_quantity > 49 AS is_anomaly, CAST(1 - l_discount AS DECIMAL(6,4)) AS match_confidence, CASE l_returnflag WHEN 'A' THEN 'code' WHEN 'R' THEN 'exact' WHEN 'N' THEN 'none' END AS match_method FROM lineitem)
"""

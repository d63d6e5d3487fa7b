"""What only larger tables bring up: other plans of joins, ties, and work that must not grow faster than its input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenprice.operators import geometry, resolve, tables
from lumenprice.plans import interpret, relational


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned as sort-merge joins and become broadcast joins when they run, over as many partitions as large tables have."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in wanted}
    for n, value in wanted.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_pages_stay_whole_behind_a_late_broadcast(spark, late_broadcasts):
    rows = spark.range(0, 4000, numPartitions=8).select(F.pmod("id", F.lit(100)).alias("doc_id"), (F.pmod("id", F.lit(100)) % 2).cast("int").alias("page"), F.floor(F.col("id") / 100).cast("int").alias("line"))
    gaps = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("page"), F.lit(15.0).alias("gap"))
    found = geometry.by_page(rows.join(gaps, ["doc_id", "page"]), ["line"], lambda own: [{"doc_id": own[0]["doc_id"], "n": len(own), "first": own[0]["line"]}], "doc_id long, n int, first int")
    assert sorted(tuple(r) for r in found.collect()) == [(i, 40, 0) for i in range(100)]


def test_synthetic_catalog_orders_equal_lines_by_item(spark, tmp_path):
    parts = [(i, f"red bolt{i // 2}", f"TYPE{i}", "Brand#1", 1) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame([(i // 2, i, 9 - i % 2, 3) for i in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    dates = {"l_shipdate": F.lit("1996-01-01").cast("timestamp"), "l_returnflag": F.lit("A"), "l_linestatus": F.lit("O")}
    lines.withColumns({c: F.lit(1.0) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | dates).write.parquet(f"{tmp_path}/lineitem.parquet")
    # item_id is doc-line-part-supplier, ordered as a string
    first = {f"red bolt{i}": min((f"{i}-3-{p}-{9 - p % 2}", f"TYPE{p}") for p in (2 * i, 2 * i + 1))[1] for i in range(20)}
    assert {r["norm"]: r["category"] for r in relational.synthetic_catalog(spark, str(tmp_path)).collect()} == first


def test_tables_are_dealt_once_and_not_stored_as_cells(spark, monkeypatch):
    sf, names = "/root/testdata/sf0.001", []
    kept = lambda df, name: names.append(name) or df
    for module in (interpret, tables):
        monkeypatch.setattr(module, "stored", kept)
    dealt = lambda df: {line.split("plan_id")[0].split("Exchange ")[1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line}
    assert len(dealt(interpret.infer_columns(spark, sf))) <= 2  # the orders, for the header and for the rows below it
    interpret.analyze_table(spark, sf)
    assert names == []
    interpret.table_items(spark, sf)
    assert names == ["roles"]


def test_services_of_one_code_and_name_are_compared_once(spark):
    services = spark.range(1, 301).selectExpr("id as service_id", "concat('Прием врача ', id % 3) as service_name", "'A1' as icd_code", "true as is_active")
    forms = spark.createDataFrame([("прием врача 2", "A1"), ("прием врача 2", "A1")], "entry string, key string")
    assert sorted(tuple(r) for r in resolve.code_pairs(forms, services).select("other", "sid").collect()) == [("прием врача 0", 3), ("прием врача 1", 1), ("прием врача 2", 2)]
    items = spark.createDataFrame([(f"i{i}", "ПРИЕМ врача 2", "a1") for i in range(50)] + [("none", None, "A1")], "item_id string, name string, code string")
    found = {r["item_id"]: (r["service_id"], r["score"]) for r in resolve.code_level(resolve.code_hits(items, services), services).collect()}
    assert found == {f"i{i}": (2, 1.0) for i in range(50)} | {"none": (1, 0.95)}


def test_density_bounds_deal_words_once_to_bounded_tasks(spark, monkeypatch):
    from lumenprice.plans import scalar

    monkeypatch.setattr(geometry, "WORDS_TASK", 1000)
    plan = scalar.density_bounds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    words = scalar._words(spark, "/root/testdata/sf0.001").count()
    assert [line.split("Exchange ")[1].split(", ")[1].rstrip(")") for line in plan.splitlines() if "Exchange " in line] == [str(-(-words // 1000))]
    rows = [(1, 1, None, 5.0, 20.0), (1, 1, 0, 60.0, 10.0), (None, 1, 0, 3.0, 9.0)]  # no line, a word that ends before it begins, no document
    odd = spark.createDataFrame(rows, "doc_id long, page int, line int, x0 double, x1 double")
    assert sorted((r["doc_id"] or 0, r["bound"]) for r in geometry.density_bounds(odd).collect()) == [(0, 3.0), (1, 5.0)]


def test_workbooks_and_documents_deal_their_cells_once(spark):
    from lumenprice.operators import sheets as rules

    assert not hasattr(rules, "stored")  # rows aren't written to be dealt again
    cells = spark.createDataFrame([(1, 0, 1, 0, "Услуга"), (1, 0, 1, 1, "Цена"), (1, 0, 2, 0, "Прием"), (1, 0, 2, 1, "500")], "doc_id long, page int, row int, column int, value string")
    for items in (rules.workbook_items, rules.document_items):
        found = items(cells, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {line.split("Exchange ")[1].split(", [plan_id")[0].split("#")[0] for line in plan.splitlines() if "Exchange hash" in line} == {"hashpartitioning(doc_id"}
        assert all(", 3), REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hash" in line)
        assert [(r["name"], [int(p["amount"]) for p in r["prices"]]) for r in found.collect()] == [("Прием", [500])]

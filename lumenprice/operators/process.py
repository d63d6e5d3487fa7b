"""From a table's items to versioned prices, and a document's status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenprice.functions import money
from lumenprice.functions.text import text_quality
from lumenprice.operators import geometry, resolve, sheets, tables, versioning
from lumenprice.sources.files import kept
from lumenprice.sources.stored import stored

#: Letters of a text layer below which a page counts as having none.
LEAST_TEXT = 20


def grid(cells: DataFrame, header_rows: int = 25, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Cells (doc_id, page, row, column, value) of files as whole grids below each page's header, and the headers.

    The header is the first of the page's first rows with the most captions, least at least; a page without one is all contents.
    """
    rows = cells.groupBy("doc_id", "page", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m"))
    last = cells.groupBy("doc_id", "page").agg(F.max("column").alias("last"))
    page = Window.partitionBy("doc_id", "page")
    words = F.lower(F.array_join(F.map_values("m"), " "))
    from_top = F.row_number().over(page.orderBy("row"))
    hits = F.when(from_top <= header_rows, sum((F.contains(words, F.lit(a)).cast("int") for a in tables.HEADER_ANCHORS), F.lit(0)))
    rows = rows.join(last, ["doc_id", "page"]).withColumn("hits", hits).withColumn("best", F.max(F.struct("hits", -F.col("row"))).over(page))
    header = F.when(F.col("best.hits") >= least, -F.col("best.col2")).otherwise(-1)
    whole = rows.select("doc_id", "page", "row", header.alias("header"), F.explode(F.sequence(F.lit(0), "last")).alias("column"), "m").withColumn("cell", F.coalesce(F.try_element_at("m", "column"), F.lit("")))
    whole = whole.drop("m")
    return whole.filter("row > header").drop("header"), whole.filter("row = header").drop("header", "row")


def prices(items: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid prices of items (see tables.items) with item_id and their document's columns, and the rows that validation refuses.

    A first and a repeated visit become two. docs: doc_id, partner_id, effective_date, currency, today.
    """
    one = items.select("*", F.posexplode(money.expand_primary_repeat(F.col("name"), F.col("prices"))).alias("part", "r")).drop("name", "prices")
    read = one.withColumn("t", money.apply_tariffs(F.col("r.prices"))).join(docs, "doc_id")
    price = lambda kind: money.convert_to_kzt(F.col(f"t.{kind}"), F.col("currency")).alias(f"price_{kind}")
    item_id = F.concat_ws("-", "doc_id", "page", "row", "part")
    read = read.select(item_id.alias("item_id"), "doc_id", "page", "row", "part", F.col("r.name").alias("name"), "code", "category", "partner_id", "effective_date", "currency", "today", *map(price, ("resident", "nonresident", "original")))
    checked = read.withColumn("v", money.validation(*map(F.col, ("name", "price_resident", "price_nonresident", "price_original", "effective_date", "currency", "today"))))
    return checked.filter("v.ok").drop("v", "today"), checked.filter("not v.ok").select("item_id", "doc_id", F.col("v.messages").alias("messages"))


def versioned(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """prices with their matches (resolve.cascade) applied and their versions in the order of documents and rows.

    needs_review is what a row had when it was taken in: by its match, or by its own jump of price; a jump that a
    later row brings doesn't change it.
    """
    matched = resolve.apply_match(rows.join(outcomes.withColumnRenamed("service_id", "service"), "item_id", "left").withColumn("was_verified", F.lit(False)))
    matched = matched.withColumns({"needs_review": F.coalesce("needs_review", F.lit(False)), "seq": F.struct("doc_id", "page", "row", "part")})
    chain = versioning.versions(matched.select("item_id", "partner_id", "service_id", "price_resident", "price_nonresident", "price_original", "effective_date", "seq"))
    chain = chain.select("item_id", "is_current", "supersedes", "change", "is_jump", (F.col("newer") & (F.coalesce("change", F.lit(0.0)) > money.JUMP)).alias("own"))
    found = matched.join(chain, "item_id", "left").fillna({"is_current": True, "is_jump": False, "own": False})
    return found.withColumn("needs_review", F.col("needs_review") | F.col("own")).drop("own", "seq")


def statuses(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, items, review (rows for review or without a service) and parse_status of all docs; one without items is an error."""
    open_ = F.count_if(F.col("needs_review") | F.col("service_id").isNull())
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), open_.alias("review"))
    found = docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["items", "review"])
    return found.withColumn("parse_status", money.document_status(F.col("items"), F.col("review")))


def extracted(cells: DataFrame, kind: str) -> DataFrame:
    """The items (doc_id, page, row, name, code, category, prices) of cells by the rules of their format: xlsx, docx, or grids of pdf or scan pages."""
    if kind == "xlsx":
        return sheets.workbook_items(cells)
    if kind == "docx":
        return sheets.document_items(cells)
    below, header = grid(stored(cells, "process-cells"))
    below = tables.parsed(below)
    return tables.items(below, stored(tables.table_roles(below, header, kind), "process-roles"), kind)


def routed(layer: DataFrame, texts: DataFrame, recognised: DataFrame) -> DataFrame:
    """The words of pages: a page whose text layer (texts: doc_id, page, text) is nearly empty or corrupt takes its recognised words, if it has any; the others their layer's."""
    text = F.coalesce("text", F.lit(""))
    poor = (F.length(F.trim(text)) < LEAST_TEXT) | text_quality(text)["is_corrupt"]
    key = ["doc_id", "page"]
    again = stored(texts.filter(poor).select(*key).join(recognised.select(*key).distinct(), key, "left_semi"), "process-recognised")
    return layer.join(again, key, "left_anti").select(recognised.columns).unionByName(recognised.join(again, key, "left_semi"))


def word_items(words: DataFrame, kind: str = "pdf") -> DataFrame:
    """The items (doc_id, page, row, name, code, category, prices) of pages of words (doc_id, page, text, x0, x1, top, bottom); row is a line's number from 0.

    Words become lines, the lines below a page's header give the streets between columns, and columns their roles by captions and contents;
    names over several lines are put together before rows are read. kind is pdf or scan: categories go on across pages or end with theirs.
    """
    lined = stored(geometry.group_rows(words), "process-lines")
    line_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    lines = lined.groupBy("doc_id", "page", "line").agg(line_text.alias("text"), F.min("top").alias("top"))
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(a)).cast("int") for a in geometry.HEADER_ANCHORS), F.lit(0))
    best = lines.filter(F.col("line") < geometry.HEADER_ROWS).groupBy("doc_id", "page").agg(F.max_by(F.struct("line", hits.alias("hits")), F.struct(hits, -F.col("line"))).alias("b"))
    header = best.select("doc_id", "page", F.when(F.col("b.hits") >= geometry.LEAST_ANCHORS, F.col("b.line")).otherwise(-1).alias("header"))
    own = stored(lined.join(header, ["doc_id", "page"], "left").fillna(-1, ["header"]), "process-words")
    bounds = geometry.density_bounds(own.filter("line > header"))
    cells = geometry.assign_cells(own.filter("line >= header").drop("header"), bounds)
    columns = bounds.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    held = cells.groupBy("doc_id", "page", "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("m")).join(columns, ["doc_id", "page"]).join(header, ["doc_id", "page"])
    grid_ = held.select("doc_id", "page", F.col("line").alias("row"), "header", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("column"), "m")
    grid_ = stored(grid_.withColumn("cell", F.coalesce(F.try_element_at("m", "column"), F.lit(""))).drop("m"), "process-grid")
    below, captions = tables.parsed(grid_.filter("row > header").drop("header")), grid_.filter("row = header").drop("header", "row")
    roles = stored(tables.table_roles(below, captions, kind), "process-roles")
    stitched = stitched_cells(below, roles, lines, geometry.line_gap(words))
    return tables.items(stitched, roles, kind)


def stitched_cells(below: DataFrame, roles: DataFrame, lines: DataFrame, gaps: DataFrame) -> DataFrame:
    """below (doc_id, page, row, column, cell, amount) with the names and codes that stitch_rows gives its rows, without the rows that went into others."""
    key = ["doc_id", "page", "row"]
    read = below.join(roles.select("doc_id", "page", "column", "is_name", "is_code", "is_price", "numbered"), ["doc_id", "page", "column"])
    read = read.withColumn("priced", F.when(F.col("is_price") & F.col("amount").isNotNull(), F.col("cell")))
    rows = read.groupBy(*key).agg(
        F.max(F.when(F.col("is_name"), F.col("cell"))).alias("name"), F.max(F.when(F.col("is_code"), F.col("cell"))).alias("code"),
        F.max("priced").alias("price"), F.coalesce(F.bool_or("numbered"), F.lit(False)).alias("numbered"),
    )
    placed = rows.join(lines.select("doc_id", "page", F.col("line").alias("row"), "top"), key).join(gaps, ["doc_id", "page"]).withColumnRenamed("row", "line")
    found = geometry.stitch_rows(placed, F.col("numbered")).withColumnRenamed("line", "row").select(*key, F.col("name").alias("_name"), F.col("code").alias("_code"))
    cell = F.when(F.col("is_name"), F.col("_name")).when(F.col("is_code"), F.col("_code")).otherwise(F.col("cell"))
    # an amount that a stitched name or code holds is its own
    amount = F.when(F.col("is_name") | F.col("is_code"), money.parse_amount(cell)).otherwise(F.col("amount"))
    return read.join(found, key).select(*key, "column", cell.alias("cell"), amount.alias("amount"))


def isolated(cells: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """extracted() of the documents that it can read, and the failures (doc_id, step, message) of the others.

    Rows of Spark don't fail one by one, so documents are tested by what breaks a step: a cell without a place, a negative one, or two values in one place. Such a
    document gives no items and one failure for each reason; all others come through.
    """
    reasons = F.array_compact(
        F.array(
            F.when(F.col("page").isNull() | F.col("row").isNull() | F.col("column").isNull(), "a cell without a place"),
            F.when((F.col("row") < 0) | (F.col("column") < 0), "a cell at a negative place"),
        )
    )
    odd = cells.select("doc_id", F.explode(reasons).alias("message"))
    twice = cells.groupBy("doc_id", "page", "row", "column").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit("two values in one cell").alias("message"))
    failures = odd.unionByName(twice).distinct().select("doc_id", F.lit("cells").alias("step"), "message")
    failures = stored(failures, "process-failures")
    sound = cells.join(failures.select("doc_id").distinct(), "doc_id", "left_anti")
    return extracted(sound, kind), failures


def logs(docs: DataFrame, failures: DataFrame, refused: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id, log: what went wrong with each document and how many items it gave, as much as the contract keeps of a log.

    failures (doc_id, step, message), refused (doc_id, messages) and taken (doc_id, a row an item) of the run.
    """
    failed = failures.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "step", "message"))).alias("failed"))
    left_out = refused.groupBy("doc_id").agg(F.count(F.lit(1)).alias("refused"))
    counted = taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))
    rows = docs.select("doc_id").join(failed, "doc_id", "left").join(left_out, "doc_id", "left").join(counted, "doc_id", "left").fillna(0, ["refused", "items"])
    lines = F.concat(
        F.coalesce("failed", F.array().cast("array<string>")),
        F.when(F.col("items") == 0, F.array(F.lit("Документ без распознаваемых данных"))).otherwise(F.array(F.concat(F.lit("Извлечено "), "items", F.lit(" позиций")))),
        F.when(F.col("refused") > 0, F.array(F.concat(F.lit("Пропущено пустых/битых строк: "), "refused"))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("doc_id", kept(F.array_join(lines, "\n"), "log").alias("log"))


def process(cells: DataFrame, docs: DataFrame, services: DataFrame, kind: str = "xlsx") -> tuple[DataFrame, DataFrame]:
    """Versioned prices of files' cells (doc_id, page, row, column, value), and their documents' statuses with their logs.

    Prices and matches are read several times, so both are stored. A document that breaks a step is an error with that in its log, and takes no other with it.
    """
    found, failures = isolated(cells, kind)
    taken, refused = prices(stored(found, "process-items"), docs)
    taken = stored(taken, "process-prices")
    rows = versioned(taken, stored(resolve.cascade(taken.select("item_id", "name", "code"), services), "process-matches"))
    return rows, statuses(rows, docs).join(logs(docs, failures, refused, taken), "doc_id")

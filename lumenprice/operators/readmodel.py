"""Read models: pages, queues, histories, search and statistics over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprice.functions.money import history_price, pct_change


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page in a total order (order must tell the rows apart) with the number of all rows as total."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), 4)


def stats_by_format(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents, items and matches of each format; documents without active items count."""
    active = items.filter("is_active").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("service_id").alias("m"))
    found = docs.join(active, "doc_id", "left").groupBy("file_format").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("m"), F.lit(0)).alias("matched")
    )
    return found.withColumn("match_rate", rate(F.col("matched"), F.col("items")))


def stats_by_partner(partners: DataFrame, items: DataFrame) -> DataFrame:
    """Active items and matches by partner name; partners of the same name are one."""
    active = items.filter("is_active").groupBy("partner_id").agg(F.count(F.lit(1)).alias("n"), F.count("service_id").alias("m"))
    found = partners.join(active, "partner_id", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("m"), F.lit(0)).alias("matched"))
    return found.withColumn("match_rate", rate(F.col("matched"), F.col("items")))


def stats_totals(items: DataFrame) -> DataFrame:
    """All counts in one pass; anomalies count in archived rows too."""
    active, matched = F.col("is_active"), F.col("service_id").isNotNull()
    found = items.agg(
        F.count(F.lit(1)).alias("items_total"), F.count_if(active).alias("items_active"), F.count_if(active & matched).alias("matched"),
        F.count_if(active & F.col("needs_review")).alias("needs_review"), F.count_if(active & ~matched & ~F.col("needs_review")).alias("unmatched"),
        F.count_if("is_anomaly").alias("anomaly"),
    )
    return found.withColumn("auto_match_rate", rate(F.col("matched"), F.col("items_active")))


def avg_processing(docs: DataFrame) -> DataFrame:
    """The mean of known processing times; null if there is none or it is zero."""
    return docs.agg(F.nullif(F.round(F.avg("processing_seconds").cast("double"), 2), F.lit(0.0)).alias("avg_processing_seconds"))


QUEUES = {
    "all": lambda: F.col("service_id").isNull() | F.col("needs_review"),
    "unmatched": lambda: F.col("service_id").isNull() & ~F.col("needs_review"),
    "needs_review": lambda: F.col("needs_review"),
    "anomaly": lambda: F.col("is_anomaly"),
}


def queue(items: DataFrame, partners: DataFrame, docs: DataFrame, mode: str = "all") -> DataFrame:
    """Active items of a queue with the names of partner and document."""
    if mode not in QUEUES:
        raise ValueError(f"mode must be one of {', '.join(QUEUES)}")
    rows = items.filter(F.col("is_active") & QUEUES[mode]())
    names = partners.select("partner_id", F.col("name").alias("partner_name"))
    files = docs.select("doc_id", F.col("file_name").alias("document_name"))
    return rows.join(names, "partner_id").join(files, "doc_id")


def with_candidates(rows: DataFrame, candidates: DataFrame, services: DataFrame) -> DataFrame:
    """rows with an array of their candidates in rank order: one join instead of one query a row."""
    named = candidates.join(services.select("service_id", "service_name"), "service_id")
    lists = named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "service_id", "service_name", "score"))).alias("candidates"))
    return rows.join(lists, "item_id", "left")


def service_partners(items: DataFrame, partners: DataFrame) -> DataFrame:
    """The active prices of services with their partners."""
    names = partners.select("partner_id", F.col("name").alias("partner_name"), "city")
    return items.filter("is_active and service_id is not null").join(names, "partner_id").select(
        "service_id", "partner_id", "partner_name", "city", "price_resident", "price_nonresident", "effective_date", "item_id"
    )


def price_history(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Every price of a partner and service in time, with its change from the last known one before."""
    before = Window.partitionBy("partner_id", "service_id").orderBy(F.col("effective_date").asc_nulls_first(), "doc_id", "line").rowsBetween(Window.unboundedPreceding, -1)
    price = history_price(F.col("price_resident"), F.col("price_nonresident"))
    rows = items.filter("service_id is not null").withColumn("price", price).withColumn("before", F.last("price", ignorenulls=True).over(before))
    return rows.join(docs.select("doc_id", "file_name", "file_format"), "doc_id").select(
        "partner_id", "service_id", "item_id", "effective_date", "price_resident", "price_nonresident", "is_active",
        F.col("file_name").alias("document_name"), "file_format", F.round(pct_change(F.col("before"), F.col("price")), 4).alias("pct_change"),
    )


def search_simple(services: DataFrame, partners: DataFrame, query: str) -> DataFrame:
    """Services and partners that have all words of the query, or the query as a part (% and _ are wild, as in LIKE)."""
    words = [w for w in query.lower().split() if w]
    parts = [
        services.filter("is_active").select(F.lit("service").alias("kind"), F.col("service_id").alias("id"), F.col("service_name").alias("title"), "category"),
        partners.filter("is_active").select(F.lit("partner").alias("kind"), F.col("partner_id").alias("id"), F.col("name").alias("title"), F.col("city").alias("category")),
    ]
    rows = parts[0].unionByName(parts[1])
    if not words:
        return rows.withColumn("rank", F.lit(0.0)).filter(F.lit(False))
    own = F.split(F.lower("title"), r"[^\p{L}\p{N}_]+")
    all_words = F.size(F.array_except(F.array(*map(F.lit, words)), own)) == 0
    return rows.withColumn("rank", F.when(all_words, 1.0).otherwise(0.0)).filter(all_words | F.col("title").ilike(f"%{query}%"))


def existing(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids."""
    return rows.join(ids.select(key), key, "left_semi")


def bars(rows: DataFrame, value: str) -> DataFrame:
    """Adds percent: the value's share of the greatest one, rounded, 0 to 100."""
    most = rows.agg(F.greatest(F.max(value), F.lit(1)).alias("most"))  # one row
    share = F.round(F.col(value) * 100.0 / F.when(F.col("most") > 0, F.col("most")).otherwise(1))
    return rows.crossJoin(F.broadcast(most)).withColumn("percent", F.greatest(F.lit(0), F.least(F.lit(100), share.cast("int")))).drop("most")


# Statuses in the order in which they are shown; unknown ones come first.
STATUS_ORDER = ("done", "processing", "pending", "needs_review", "error")


def status_place(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUS_ORDER)), status) - 1


def envelope(hits: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One row: query, total (of this page's hits, not of all) and results, an array by rank, then kind and id; a blank query has none."""
    asked = query.strip()
    order = [F.col("rank").desc(), F.col("kind"), F.col("id")]
    shown = hits.filter(F.lit(asked != "")).orderBy(*order).offset(offset).limit(limit).select((-F.col("rank")).alias("o"), "kind", "id", "title", "category")
    found = shown.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("o", "kind", "id", "title", "category"))).alias("results"))
    named = lambda r: F.struct(r["kind"].alias("kind"), r["id"].alias("id"), r["title"].alias("title"), r["category"].alias("category"), (-r["o"]).alias("rank"))
    return found.select(F.lit(asked).alias("query"), "total", F.transform("results", named).alias("results"))

"""Queries over the catalogue's tables: statistics, pages, queues, histories, versions and upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.functions import text
from lumenprice.operators import catalog, readmodel, resolve, versioning
from lumenprice.plans import domain, inline
from lumenprice.plans.registry import query
from lumenprice.sources.stored import shared_dir

W = "WITH " + domain.SQL
RATE = "round(CASE WHEN {1} = 0 THEN 0.0 ELSE CAST({0} AS DOUBLE) / {1} END, 4)"


@query(f"""{W} SELECT file_format, count(DISTINCT d.doc_id) AS documents, count(i.item_id) AS items, count(i.service_id) AS matched,
  {RATE.format('count(i.service_id)', 'count(i.item_id)')} AS match_rate FROM docs d LEFT JOIN items i ON d.doc_id = i.doc_id AND i.is_active GROUP BY 1""")
def stats_by_format(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.stats_by_format(domain.documents(spark, d), domain.items(spark, d))


@query(f"""{W} SELECT name, count(i.item_id) AS items, count(i.service_id) AS matched, {RATE.format('count(i.service_id)', 'count(i.item_id)')} AS match_rate
  FROM partners p LEFT JOIN items i ON p.partner_id = i.partner_id AND i.is_active GROUP BY 1""")
def stats_by_partner(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.stats_by_partner(domain.partners(spark, d), domain.items(spark, d))


@query(f"""{W}, c AS (SELECT count(*) AS items_total, count(*) FILTER (is_active) AS items_active, count(*) FILTER (is_active AND service_id IS NOT NULL) AS matched,
  count(*) FILTER (is_active AND needs_review) AS needs_review, count(*) FILTER (is_active AND service_id IS NULL AND NOT needs_review) AS unmatched, count(*) FILTER (is_anomaly) AS anomaly FROM items)
  SELECT *, {RATE.format('matched', 'items_active')} AS auto_match_rate FROM c""")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.stats_totals(domain.items(spark, d))


@query(f"{W} SELECT parse_status, count(*) AS documents FROM docs GROUP BY 1")
def docs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return domain.documents(spark, d).groupBy("parse_status").agg(F.count(F.lit(1)).alias("documents"))


@query(f"{W} SELECT nullif(round(CAST(sum(processing_seconds) AS DOUBLE) / count(processing_seconds), 2), 0) AS avg_processing_seconds FROM docs")
def avg_processing(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.avg_processing(domain.documents(spark, d))


@query(f"{W} SELECT item_id, price_resident, (SELECT count(*) FROM items WHERE is_active) AS total FROM items WHERE is_active ORDER BY price_resident NULLS LAST, item_id LIMIT 100")
def items_active_page(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.items(spark, d).filter("is_active").select("item_id", "price_resident")
    return readmodel.page(rows, [F.col("price_resident").asc_nulls_last(), F.col("item_id")], 100)


@query(f"""{W}, x AS (SELECT i.item_id, i.partner_id, s.service_name, i.price_resident FROM items i JOIN services s ON i.part_id = s.service_id WHERE i.is_active AND i.partner_id = 1)
  SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY service_name, item_id LIMIT 50 OFFSET 10""")
def partner_price_list(spark: SparkSession, d: str) -> DataFrame:
    names = domain.services(spark, d).select(F.col("service_id").alias("part_id"), "service_name")
    rows = domain.items(spark, d).filter("is_active and partner_id = 1").join(names, "part_id").select("item_id", "partner_id", "service_name", "price_resident")
    return readmodel.page(rows, [F.col("service_name"), F.col("item_id")], 50, 10, most=1000)


@query(f"{W} SELECT * FROM services WHERE category = (SELECT min(category) FROM services) AND service_name ILIKE '%a%' ORDER BY service_name, service_id LIMIT 50")
def services_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.services(spark, d)
    first = rows.agg(F.min("category").alias("category"))
    return rows.join(F.broadcast(first), "category").filter(F.col("service_name").ilike("%a%")).orderBy("service_name", "service_id").limit(50)  # one row


@query(f"{W} SELECT * FROM partners WHERE is_active AND city = 'FRANCE' OR city = 'nation_3' AND is_active OR name ILIKE '%1_'")
def partners_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("city")
    return domain.partners(spark, d).filter((F.col("is_active").eqNullSafe(F.lit(True)) & c.isin("FRANCE", "nation_3")) | F.col("name").ilike("%1_"))


@query(f"""{W} SELECT service_id, i.partner_id, p.name AS partner_name, city, price_resident, price_nonresident, effective_date, item_id
  FROM items i JOIN partners p ON i.partner_id = p.partner_id WHERE i.is_active AND service_id IS NOT NULL""")
def service_partners(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.service_partners(domain.items(spark, d), domain.partners(spark, d))


@query(f"""{W}, p AS (SELECT *, CASE WHEN price_resident <> 0 THEN price_resident ELSE price_nonresident END AS price FROM items WHERE service_id IS NOT NULL),
  h AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY partner_id, service_id ORDER BY effective_date NULLS FIRST, doc_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
  SELECT partner_id, service_id, item_id, h.effective_date, price_resident, price_nonresident, is_active, file_name AS document_name, file_format,
  round(CASE WHEN before <> 0 THEN CAST(abs(price - before) AS DOUBLE) / CAST(before AS DOUBLE) END, 4) AS pct_change FROM h JOIN docs ON h.doc_id = docs.doc_id""")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.price_history(domain.items(spark, d), domain.documents(spark, d))


QUEUE = {
    "all": "service_id IS NULL OR needs_review", "unmatched": "service_id IS NULL AND NOT needs_review", "needs_review": "needs_review", "anomaly": "is_anomaly",
}


def _queue_sql(mode: str) -> str:
    return f"""{W} SELECT item_id, match_confidence, p.name AS partner_name, file_name AS document_name FROM items i JOIN partners p ON i.partner_id = p.partner_id
  JOIN docs d ON i.doc_id = d.doc_id WHERE i.is_active AND ({QUEUE[mode]})"""


def _queue(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = readmodel.queue(domain.items(spark, d), domain.partners(spark, d), domain.documents(spark, d).drop("effective_date"), mode)
    return rows.select("item_id", "match_confidence", "partner_name", "document_name")


@query(_queue_sql("all"))
def queue_all(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d, "all")


@query(_queue_sql("unmatched"))
def queue_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d, "unmatched")


@query(_queue_sql("needs_review"))
def queue_needs_review(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d, "needs_review")


@query(_queue_sql("anomaly"))
def queue_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d, "anomaly")


#: Candidates of each unmatched item: the services of the same brand code's first three ids, ranked.
CANDIDATES = """cand AS (SELECT item_id, c.service_id, c.rank, CAST(1.0 / (1 + c.rank) AS DOUBLE) AS score FROM items i JOIN
  (SELECT icd_code, service_id, row_number() OVER (PARTITION BY icd_code ORDER BY service_id) - 1 AS rank FROM services) c
  ON c.icd_code = (SELECT s.icd_code FROM services s WHERE s.service_id = i.part_id) WHERE i.service_id IS NULL AND c.rank < 3)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    services = domain.services(spark, d)
    from lumenprice.operators.blocks import top

    ranked = top(services.select("icd_code", "service_id"), 3, ["icd_code"], [F.col("service_id")])
    codes = services.select(F.col("service_id").alias("part_id"), "icd_code")
    items = domain.items(spark, d).filter("service_id is null").select("item_id", "part_id")
    return items.join(codes, "part_id").join(ranked, "icd_code").select("item_id", "service_id", "rank", (F.lit(1.0) / (1 + F.col("rank"))).alias("score"))


@query(f"""{W}, {CANDIDATES}, l AS (SELECT item_id, string_agg(c.service_id || ':' || s.service_name, '|' ORDER BY rank) AS candidates, count(*) AS n FROM cand c JOIN services s ON c.service_id = s.service_id GROUP BY 1)
  SELECT i.item_id, l.candidates, l.n FROM items i JOIN partners p ON i.partner_id = p.partner_id JOIN docs d ON i.doc_id = d.doc_id LEFT JOIN l ON l.item_id = i.item_id
  WHERE i.is_active AND (i.service_id IS NULL OR i.needs_review)""")
def queue_with_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = readmodel.with_candidates(_queue(spark, d, "all"), _candidates(spark, d), domain.services(spark, d))
    names = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["service_id"].cast("string"), c["service_name"])), "|")
    return rows.select("item_id", names.alias("candidates"), F.when(F.col("candidates").isNotNull(), F.size("candidates").cast("long")).alias("n"))


@query(f"{W} SELECT doc_id, file_name, parse_status, created_at FROM docs WHERE parse_status = 'needs_review' ORDER BY created_at DESC, doc_id LIMIT 100")
def documents_list(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.documents(spark, d).filter("parse_status = 'needs_review'").select("doc_id", "file_name", "parse_status", "created_at")
    return rows.orderBy(F.desc_nulls_first("created_at"), "doc_id").limit(100)


@query(f"""{W}, h AS (SELECT 'service' AS kind, service_id AS id, service_name AS title, category FROM services WHERE is_active UNION ALL SELECT 'partner', partner_id, name, city FROM partners WHERE is_active),
  r AS (SELECT *, list_contains(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), 'red') AS hit FROM h)
  SELECT kind, id, title, category, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS rank FROM r WHERE hit OR title ILIKE '%red%'""")
def search_simple(spark: SparkSession, d: str) -> DataFrame:
    return readmodel.search_simple(domain.services(spark, d), domain.partners(spark, d), "red").withColumn("rank", F.col("rank").cast("decimal(2,1)"))


#: Versions by recursion over each key's rows in order: the active row, and what each row did.
VERSIONS = f"""{W}, s AS (SELECT *, coalesce(price_resident, price_nonresident) AS p, row_number() OVER (PARTITION BY partner_id, service_id ORDER BY doc_id, line, item_id) AS k FROM items WHERE service_id IS NOT NULL),
  g AS (SELECT *, sum(CASE WHEN effective_date IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY partner_id, service_id ORDER BY k) AS st FROM s),
  a AS (SELECT *, max((coalesce(effective_date, DATE '0001-01-01'), k)) OVER (PARTITION BY partner_id, service_id, st ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM g),
  b AS (SELECT *, run[2] AS run_k, lag(run[2]) OVER (PARTITION BY partner_id, service_id ORDER BY k) AS prev_k, last_value(run[2]) OVER (PARTITION BY partner_id, service_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_k FROM a),
  c AS (SELECT b.*, q.item_id AS supersedes, q.p AS prev_p, b.run_k = b.k AS newer, b.final_k = b.k AS is_current FROM b LEFT JOIN s q ON q.partner_id = b.partner_id AND q.service_id = b.service_id AND q.k = b.prev_k),
  v AS (SELECT *, CASE WHEN supersedes IS NOT NULL THEN CASE WHEN newer THEN CASE WHEN prev_p <> 0 THEN CAST(abs(p - prev_p) AS DOUBLE) / CAST(prev_p AS DOUBLE) END
    ELSE CASE WHEN p <> 0 THEN CAST(abs(prev_p - p) AS DOUBLE) / CAST(p AS DOUBLE) END END END AS change FROM c)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    # line numbers aren't unique within a document: the item's id decides last
    items = domain.items(spark, d).withColumn("seq", F.struct("doc_id", "line", "item_id"))
    return versioning.versions(items)


@query(f"{VERSIONS} SELECT item_id, supersedes, newer, round(change, 6) AS change FROM v")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("item_id", "supersedes", "newer", F.round("change", 6).alias("change"))


@query(f"{VERSIONS}, j AS (SELECT DISTINCT CASE WHEN newer THEN item_id ELSE supersedes END AS item_id FROM v WHERE change > 0.5) SELECT item_id FROM j")
def version_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).filter("is_jump").select("item_id")


@query(f"""{VERSIONS}, j AS (SELECT DISTINCT CASE WHEN newer THEN item_id ELSE supersedes END AS item_id FROM v WHERE change > 0.5)
  SELECT item_id, supersedes, is_current AS is_active, item_id IN (SELECT item_id FROM j) AS is_anomaly FROM v
  UNION ALL SELECT item_id, NULL, TRUE, FALSE FROM items WHERE service_id IS NULL""")
def version_batches(spark: SparkSession, d: str) -> DataFrame:
    """The table of versions after the documents came in three batches."""
    items = domain.items(spark, d).select("item_id", "partner_id", "service_id", "price_resident", "price_nonresident", "effective_date", F.struct("doc_id", "line", "item_id").alias("seq"))
    last, path = items.agg(F.max("seq.doc_id")).first()[0] or 0, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    for i in range(3):
        part = (F.col("seq.doc_id") > last * i // 3) if i else F.lit(True)
        versioning.merge_into(spark, path, items.filter(part & (F.col("seq.doc_id") <= last * (i + 1) // 3)))
    return versioning.table_of(spark, path).select("item_id", "supersedes", "is_active", "is_anomaly")


@query(f"{VERSIONS} SELECT partner_id, service_id, item_id, effective_date FROM v WHERE is_current")
def version_active(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).filter("is_current").select("partner_id", "service_id", "item_id", "effective_date")


@query(f"{W} SELECT partner_id, service_id, CAST(date_trunc('year', effective_date) AS DATE) AS effective_date, count(*) AS n FROM items WHERE service_id IS NOT NULL AND effective_date IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_same_date(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.items(spark, d).filter("service_id is not null and effective_date is not null").withColumn("effective_date", F.trunc("effective_date", "year"))
    return rows.groupBy("partner_id", "service_id", "effective_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"""{W}, f AS (SELECT lower(service_name) AS entry, min(service_id) AS service_id FROM services WHERE is_active GROUP BY 1)
  SELECT p.p_partkey AS part_id, f.service_id FROM part p LEFT JOIN f ON lower(p.p_name) = f.entry""")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.services(spark, d)
    names = rows.select(F.col("service_id").alias("part_id"), F.col("service_name").alias("name"))
    return resolve.exact_match(names, resolve.lexical_index(rows)).select("part_id", "service_id")


@query(f"""{W}, h AS (SELECT upper(replace(trim(icd_code), ' ', '')) AS key, count(DISTINCT service_id) AS hits, min(service_id) AS first FROM services WHERE is_active GROUP BY 1)
  SELECT i.item_id, coalesce(h.hits, 0) AS hits, CASE WHEN h.hits = 1 THEN h.first END AS service_id, CASE WHEN h.hits = 1 THEN 0.98 END AS score
  FROM items i JOIN services s ON i.part_id = s.service_id LEFT JOIN h ON h.key = upper(replace(trim(s.icd_code), ' ', ''))""")
def code_match_hits(spark: SparkSession, d: str) -> DataFrame:
    services = domain.services(spark, d)
    codes = services.select(F.col("service_id").alias("part_id"), F.col("icd_code").alias("code"))
    rows = domain.items(spark, d).select("item_id", "part_id").join(codes, "part_id").select("item_id", "code")
    return resolve.code_hits(rows, services).drop("code").withColumn("score", F.col("score").cast("decimal(3,2)"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, greatest(0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
  SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 45""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return resolve.vector_top(rows.filter("id % 50 = 0"), rows).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


LISTS = f"""{W}, {CANDIDATES}, lex AS (SELECT item_id, service_id, score * 0.9 AS score, 'fuzzy' AS method, 0 AS src FROM cand),
  sem AS (SELECT item_id, service_id, CASE WHEN rank = 1 THEN 0.97 ELSE score * 0.5 END AS score, 'embedding' AS method, 1 AS src FROM cand),
  u AS (SELECT *, row_number() OVER (PARTITION BY item_id, service_id ORDER BY score DESC, src) AS n FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem)),
  m AS (SELECT item_id, service_id, round(score, 6) AS score, method, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, src, service_id) - 1 AS rank FROM u WHERE n = 1 QUALIFY rank < 50)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    found = _candidates(spark, d)
    lexical = found.select("item_id", "service_id", (F.col("score") * 0.9).alias("score"), F.lit("fuzzy").alias("method"))
    semantic = found.select("item_id", "service_id", F.when(F.col("rank") == 1, 0.97).otherwise(F.col("score") * 0.5).alias("score"), F.lit("embedding").alias("method"))
    rows = resolve.merge_candidates(lexical, semantic)
    return rows.select("item_id", "service_id", F.round("score", 6).alias("score"), "method", F.col("rank").cast("long").alias("rank"))


@query(f"{LISTS} SELECT * FROM m")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query(f"{LISTS} SELECT * FROM m WHERE rank < 10")
def store_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).filter(F.col("rank") < resolve.STORED)


@query(f"""{LISTS} SELECT item_id, score, CASE WHEN method = 'fuzzy' AND score >= 0.92 OR score >= 0.85 THEN 'auto' WHEN score >= 0.40 THEN 'arbiter' ELSE 'review' END AS gate FROM m WHERE rank = 0""")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).filter("rank = 0").select("item_id", "score", resolve.gate(F.col("score"), F.col("method")).alias("gate"))


MATCHES = f"""{W}, r AS (SELECT item_id, service_id AS service, CAST(match_confidence AS DOUBLE) AS score, CASE line % 4 WHEN 0 THEN 'llm' ELSE match_method END AS method,
  CASE line % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS arbiter, line % 2 AS candidates, is_anomaly AS was_verified FROM items)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return domain.items(spark, d).select(
        "item_id", F.col("service_id").alias("service"), F.col("match_confidence").cast("double").alias("score"), F.when(line % 4 == 0, "llm").otherwise(F.col("match_method")).alias("method"),
        F.when(line % 3 == 0, "yes").when(line % 3 == 1, "no").alias("arbiter"), (line % 2).alias("candidates"), F.col("is_anomaly").alias("was_verified"),
    )


@query(f"""{MATCHES} SELECT item_id, service AS service_id, score AS match_confidence, method AS match_method,
  CASE WHEN service IS NOT NULL AND (score >= 0.85 OR arbiter = 'yes') THEN FALSE WHEN service IS NOT NULL THEN TRUE WHEN arbiter = 'no' THEN FALSE ELSE candidates > 0 END AS needs_review,
  CASE WHEN service IS NOT NULL AND (score >= 0.85 OR arbiter = 'yes') THEN method IN ('exact', 'llm') ELSE was_verified END AS is_verified FROM r""")
def apply_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.apply_match(_matches(spark, d)).select("item_id", "service_id", "match_confidence", "match_method", "needs_review", "is_verified")


@query(f"""{W}, a AS (SELECT i.*, x.action FROM items i LEFT JOIN (SELECT * FROM {inline.DECISIONS.sql()}) x ON i.line - 1 = x.n)
  SELECT item_id, CASE WHEN action = 'reject' THEN NULL WHEN action IS NOT NULL THEN part_id ELSE service_id END AS service_id, CASE WHEN action IS NOT NULL THEN 'manual' ELSE match_method END AS match_method,
  CASE WHEN action = 'reject' THEN 0.0 WHEN action IS NOT NULL THEN 1.0 ELSE CAST(match_confidence AS DOUBLE) END AS match_confidence, CASE WHEN action IS NOT NULL THEN FALSE ELSE needs_review END AS needs_review,
  action IS NOT NULL AS is_verified, CASE action WHEN 'reject' THEN 'Оператор: совпадения нет' WHEN 'confirm' THEN 'Оператор подтвердил' WHEN 'correct' THEN 'Оператор исправил' END AS note FROM a""")
def manual_match(spark: SparkSession, d: str) -> DataFrame:
    items = domain.items(spark, d)
    few = inline.DECISIONS.frame(spark)
    decisions = items.join(F.broadcast(few), F.col("line") - 1 == F.col("n")).select("item_id", "action", F.col("part_id").alias("chosen"))  # three rows
    rows = resolve.manual_match(items, decisions)
    return rows.select("item_id", "service_id", "match_method", "match_confidence", "needs_review", "is_verified", "note")


@query(f"""{W}, l AS (SELECT service_id, category || ' ' || lower(service_name) AS raw FROM services UNION ALL SELECT service_id, upper(service_name) FROM services UNION ALL SELECT service_id, upper(category || ' ' || service_name) FROM services),
  n AS (SELECT l.service_id, raw, trim(regexp_replace(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS form, trim(regexp_replace(regexp_replace(lower(service_name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS own, s.service_id % 2 = 0 AND lower(raw) = lower(s.category || ' ' || s.service_name) AS there FROM l JOIN services s ON l.service_id = s.service_id),
  f AS (SELECT service_id, form, min(raw) AS raw FROM n WHERE form <> own AND NOT there GROUP BY 1, 2) SELECT service_id, string_agg(raw, '|' ORDER BY raw) AS synonyms FROM f GROUP BY 1""")
def learn_synonyms(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.services(spark, d)
    learned = [F.concat_ws(" ", "category", F.lower("service_name")), F.upper("service_name"), F.upper(F.concat_ws(" ", "category", "service_name"))]
    raw = rows.select("service_id", F.explode(F.array(*learned)).alias("raw"))
    known = rows.withColumn("synonyms", F.when(F.col("service_id") % 2 == 0, F.array(F.concat_ws(" ", "category", "service_name"))))
    return resolve.learn_synonyms(known, raw).select("service_id", F.array_join("synonyms", "|").alias("synonyms"))


@query(f"""{W}, i AS (SELECT s.service_name AS name, s.category, i.doc_id, i.line, i.item_id FROM items i JOIN services s ON i.part_id = s.service_id),
  j AS (SELECT CASE WHEN line % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN line > 2 THEN category END AS category, row_number() OVER (ORDER BY doc_id, line, item_id) AS seq FROM i),
  k AS (SELECT lower(name) AS norm, name, count(*) AS n, min(seq) AS seq FROM j GROUP BY 1, 2), c AS (SELECT lower(name) AS norm, arg_min(category, seq) FILTER (category IS NOT NULL) AS category FROM j GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, seq) AS o FROM k)
  SELECT r.norm, max(CASE WHEN o = 1 THEN name END) AS service_name, coalesce(string_agg(CASE WHEN o > 1 THEN name END, '|' ORDER BY name), '') AS synonyms, any_value(c.category) AS category, CAST(sum(n) AS BIGINT) AS n
  FROM r JOIN c ON r.norm = c.norm GROUP BY 1""")
def synthetic_catalog(spark: SparkSession, d: str) -> DataFrame:
    names = domain.services(spark, d).select(F.col("service_id").alias("part_id"), "service_name", "category")
    even = F.col("line") % 2 == 0
    rows = domain.items(spark, d).join(names, "part_id").select(
        F.when(even, F.upper("service_name")).otherwise(F.col("service_name")).alias("name"), F.when(F.col("line") > 2, F.col("category")).alias("category"),
        F.struct("doc_id", "line", "item_id").alias("seq"),
    )
    return catalog.synthetic_catalog(rows).withColumn("synonyms", F.array_join("synonyms", "|"))


@query(f"""{W}, n AS (SELECT *, row_number() OVER (PARTITION BY service_name, CASE WHEN service_id % 3 <> 0 THEN icd_code END ORDER BY service_id) AS k FROM services WHERE service_id % 2 = 0)
  SELECT service_id, service_name FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM services o WHERE o.service_id % 2 = 1 AND o.service_name = n.service_name AND
  CASE WHEN o.service_id % 3 <> 0 THEN o.icd_code END IS NOT DISTINCT FROM CASE WHEN n.service_id % 3 <> 0 THEN n.icd_code END)""")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.services(spark, d).withColumn("icd_code", F.when(F.col("service_id") % 3 != 0, F.col("icd_code"))).withColumn("seq", F.col("service_id"))
    return catalog.new_services(rows.filter("service_id % 2 = 0"), rows.filter("service_id % 2 = 1")).select("service_id", "service_name")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS seq, 'ТОО ' || n_name || ' ' || s_suppkey % 7 AS name, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey % 20 AS VARCHAR) END AS bin FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  m AS (SELECT *, lower(substr(name, 5)) AS norm FROM p), n AS (SELECT *, row_number() OVER (ORDER BY seq) AS o FROM m WHERE seq % 5 <> 0),
  s AS (SELECT CAST(0 AS BIGINT) AS o, list(bin) FILTER (bin IS NOT NULL) AS bins, list(norm) AS norms, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS norm FROM m WHERE seq % 5 = 0
    UNION ALL SELECT n.o, CASE WHEN fresh AND bin IS NOT NULL THEN list_append(bins, bin) ELSE bins END, CASE WHEN fresh THEN list_append(norms, n.norm) ELSE norms END, CASE WHEN fresh THEN n.seq END, n.norm
    FROM (SELECT n.*, s.bins, s.norms, NOT (bin IS NOT NULL AND coalesce(list_contains(s.bins, bin), FALSE)) AND NOT coalesce(list_contains(s.norms, n.norm), FALSE) AS fresh FROM s JOIN n ON n.o = s.o + 1) n)
  SELECT CAST(seq AS BIGINT) AS seq, norm FROM s WHERE seq IS NOT NULL""")
def partner_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.partners(spark, d).select(
        F.col("partner_id").alias("seq"), F.concat(F.lit("ТОО "), "city", F.lit(" "), F.col("partner_id") % 7).alias("name"), F.when(F.col("partner_id") % 4 == 0, (F.col("partner_id") % 20).cast("string")).alias("bin")
    )
    return catalog.new_partners(rows.filter("seq % 5 <> 0"), rows.filter("seq % 5 = 0")).select("seq", "norm")


@query(f"{W} SELECT item_id, is_active AND doc_id NOT IN (SELECT doc_id FROM docs WHERE parse_status = 'pending') AS is_active FROM items")
def archive_document(spark: SparkSession, d: str) -> DataFrame:
    again = domain.documents(spark, d).filter("parse_status = 'pending'")
    return catalog.archive(domain.items(spark, d), again).select("item_id", "is_active")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS file_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, file_hash FROM h WHERE k = 1 AND file_hash NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL)""")
def dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    files = domain.table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    known = domain.table(spark, d, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return catalog.register(files, known)


@query(f"""{W}, c AS (SELECT count(*) AS total, count(service_id) AS auto, count(*) FILTER (needs_review) AS review, count(*) FILTER (service_id IS NULL AND NOT needs_review) AS unmatched FROM items WHERE is_active)
  SELECT *, round(auto * 100.0 / total, 2) AS auto_pct FROM (SELECT total, auto, review, unmatched FROM c)""")
def rematch_kpis(spark: SparkSession, d: str) -> DataFrame:
    return resolve.rematch_kpis(domain.items(spark, d).filter("is_active"))


@query(f"{W} SELECT match_method, count(*) AS n, count(DISTINCT partner_id) AS partners FROM items WHERE is_active GROUP BY 1")
def method_distribution(spark: SparkSession, d: str) -> DataFrame:
    return domain.items(spark, d).filter("is_active").groupBy("match_method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partner_id").alias("partners"))


@query(f"{LISTS} SELECT CASE WHEN score >= 0.95 THEN '0.95+' WHEN score >= 0.85 THEN '0.85-0.95' WHEN score >= 0.6 THEN '0.60-0.85' WHEN score >= 0.4 THEN '0.40-0.60' ELSE '<0.40' END AS band, count(*) AS n FROM m GROUP BY 1")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).groupBy(resolve.bands(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{W}, k AS (SELECT DISTINCT sha256('llm:m:' || service_name || '::' || category || '||' || icd_code) AS cache_key FROM services),
  c AS (SELECT sha256('llm:m:' || service_name || '::' || category || '||' || icd_code) AS cache_key FROM services WHERE service_id % 3 = 0) SELECT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)""")
def arbiter_pending(spark: SparkSession, d: str) -> DataFrame:
    keyed = domain.services(spark, d).withColumn("cache_key", text.cache_key("llm", "m", F.col("service_name"), F.array("category", "icd_code")))
    return resolve.arbiter_pending(keyed, keyed.filter("service_id % 3 = 0").select("cache_key"))

"""Queries of fuzzy matching and of the whole cascade over misspelt names, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.operators import resolve
from lumenprice.plans import domain
from lumenprice.plans.registry import query


def services(spark: SparkSession, d: str) -> DataFrame:
    """The services of the catalogue under longer names."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "#", " ")))
    return domain.table(spark, d, "part").select(
        F.col("p_partkey").alias("service_id"), name.alias("service_name"), F.concat("p_brand", F.lit("."), "p_size").alias("icd_code"), (F.col("p_size") % 10 != 0).alias("is_active"),
        F.concat_ws(" ", F.lower("p_type"), F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))).alias("misspelt"),
    )


#: Names and entries: their tokens sorted, and for each name the positions of its letters as bits.
NAMES = f"""WITH {domain.SQL},
  s AS (SELECT p_partkey AS service_id, p_name || ' ' || lower(p_type) || ' ' || lower(replace(p_brand, '#', ' ')) AS entry, upper(p_brand || '.' || p_size) AS code,
    p_size % 10 <> 0 AS is_active, lower(p_type) || ' ' || substr(p_name, 1, 2) || substr(p_name, 4) AS misspelt FROM part)"""


def _masks(source: str, column: str) -> str:
    letters = f"SELECT {column} AS t, unnest(string_split({column}, '')) AS c, generate_subscripts(string_split({column}, ''), 1) AS i FROM {source}"
    return f"SELECT t, map(list(c), list(k)) AS spots FROM (SELECT t, c, sum(CAST(power(2, i - 1) AS BIGINT))::BIGINT AS k FROM ({letters}) GROUP BY t, c) GROUP BY t"


def _lcs(at: str, size: str, other: str) -> str:
    """Length of the longest common subsequence of a text of so many letters, whose letters' places are in the map at, and another text."""
    full = f"(CAST(power(2, {size}) AS BIGINT) - 1)"
    steps = f"list_prepend({full}, list_transform(string_split({other}, ''), lambda c: coalesce({at}[c], 0)))"
    return f"({size} - bit_count(list_reduce({steps}, lambda row, k: ((row + (row & k)) | (row & ~k)) & {full})))"


#: For distinct names (asked: name) the 20 best services (fuzzy: name, service_id, score, rank).
FUZZY = f"""entries AS (SELECT DISTINCT entry FROM s WHERE is_active),
  e AS (SELECT entry, array_to_string(list_sort(string_split(entry, ' ')), ' ') AS sorted FROM entries),
  q AS (SELECT name, array_to_string(list_sort(string_split(name, ' ')), ' ') AS sorted FROM asked),
  qm AS ({_masks("(SELECT DISTINCT sorted FROM q)", "sorted")}),
  rated AS (SELECT name, entry, 200.0::DOUBLE * {_lcs("spots", "length(t)", "e.sorted")} / (length(t) + length(e.sorted)) AS ts FROM q JOIN qm ON t = q.sorted, e),
  near AS (SELECT name, entry, ts, service_id FROM rated JOIN s USING (entry) WHERE is_active QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, service_id) <= 40),
  pairs AS (SELECT DISTINCT name, entry, CASE WHEN length(name) > length(entry) THEN entry ELSE name END AS a, CASE WHEN length(name) > length(entry) THEN name ELSE entry END AS b FROM near),
  am AS ({_masks("(SELECT DISTINCT a FROM pairs UNION SELECT DISTINCT b FROM pairs WHERE length(a) = length(b))", "a")}),
  ways AS (SELECT name, entry, a, b FROM pairs UNION SELECT name, entry, b, a FROM pairs WHERE length(a) = length(b)),
  cuts AS (SELECT name, entry, a, substr(b, greatest(lo, 0) + 1, lo + length(a) - greatest(lo, 0)) AS w FROM (SELECT *, unnest(range(1 - length(a), length(b))) AS lo FROM ways)),
  parts AS (SELECT name, entry, max(200.0::DOUBLE * {_lcs("spots", "length(a)", "w")} / (length(a) + length(w))) AS part FROM cuts JOIN am ON t = a GROUP BY name, entry),
  fuzzy AS (SELECT name, service_id, round(greatest(ts, 0.5::DOUBLE * ts + 0.5::DOUBLE * part) / 100, 6) AS score FROM near JOIN parts USING (name, entry)),
  fuzzy_top AS (SELECT name, service_id, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, service_id) - 1 AS rank FROM fuzzy QUALIFY rank < 20)"""


@query(f"{NAMES}, asked AS (SELECT DISTINCT misspelt AS name FROM s), {FUZZY} SELECT name, service_id, score, rank FROM fuzzy_top")
def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = services(spark, d)
    return resolve.fuzzy_top(rows.select(F.col("misspelt").alias("name")), resolve.lexical_index(rows)).withColumn("rank", F.col("rank").cast("long"))


ITEMS = """i AS (SELECT item_id, CASE WHEN line % 2 = 0 THEN misspelt ELSE entry END AS name, CASE WHEN line % 3 = 0 THEN code END AS code FROM items JOIN s ON part_id = s.service_id)"""
CASCADE = f"""{NAMES}, {ITEMS},
  codes AS (SELECT code, count(DISTINCT service_id) AS hits, min(service_id) AS first FROM s WHERE is_active GROUP BY code),
  h AS (SELECT item_id, name, i.code, coalesce(hits, 0) AS hits, first FROM i LEFT JOIN codes USING (code)),
  one AS (SELECT item_id, first AS service_id, 0.98::DOUBLE AS score, 'code' AS method FROM h WHERE hits = 1),
  many AS (SELECT DISTINCT name, code, array_to_string(list_sort(string_split(name, ' ')), ' ') AS sorted FROM h WHERE hits > 1),
  mm AS ({_masks("(SELECT DISTINCT sorted FROM many)", "sorted")}),
  sims AS (SELECT m.name, m.code, service_id, 200.0::DOUBLE * {_lcs("spots", "length(t)", "array_to_string(list_sort(string_split(entry, ' ')), ' ')")} / (length(t) + length(entry)) / 100 AS sim
    FROM many m JOIN mm ON t = m.sorted JOIN s USING (code) WHERE is_active QUALIFY row_number() OVER (PARTITION BY m.name, m.code ORDER BY sim DESC, service_id) = 1),
  several AS (SELECT item_id, sims.service_id, greatest(0.95::DOUBLE, sim) AS score, 'code' AS method FROM h JOIN sims USING (name, code) WHERE hits > 1),
  forms AS (SELECT entry, min(service_id) AS service_id FROM s WHERE is_active GROUP BY entry),
  x AS (SELECT item_id, name, service_id FROM h LEFT JOIN forms ON entry = name WHERE hits = 0),
  asked AS (SELECT DISTINCT name FROM x WHERE service_id IS NULL), {FUZZY}"""


@query(f"""{CASCADE}, best AS (SELECT name, service_id, score FROM fuzzy_top WHERE rank = 0), n AS (SELECT name, count(*) AS candidates FROM fuzzy_top GROUP BY name)
  SELECT item_id, service_id, round(score, 6) AS score, method, CAST(1 AS BIGINT) AS candidates FROM (SELECT * FROM one UNION ALL SELECT * FROM several UNION ALL SELECT item_id, service_id, 1.0, 'exact' FROM x WHERE service_id IS NOT NULL)
  UNION ALL SELECT item_id, CASE WHEN score >= 0.85 THEN best.service_id END, coalesce(score, 0), CASE WHEN score >= 0.85 THEN 'fuzzy' ELSE 'none' END, coalesce(candidates, 0)
  FROM x LEFT JOIN best USING (name) LEFT JOIN n USING (name) WHERE x.service_id IS NULL""")
def cascade_full(spark: SparkSession, d: str) -> DataFrame:
    rows = services(spark, d)
    names = rows.select(F.col("service_id").alias("part_id"), "service_name", "misspelt", "icd_code")
    items = domain.items(spark, d).select("item_id", "part_id", "line").join(names, "part_id")
    asked = items.select("item_id", F.when(F.col("line") % 2 == 0, F.col("misspelt")).otherwise(F.col("service_name")).alias("name"), F.when(F.col("line") % 3 == 0, F.col("icd_code")).alias("code"))
    return resolve.cascade(asked, rows).select("item_id", "service_id", F.round("score", 6).alias("score"), "method", "candidates")

"""Queries of scalar semantics and table geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.functions import money, text
from lumenprice.operators import geometry
from lumenprice.plans import domain, inline
from lumenprice.plans.registry import query
from lumenprice.sources import files

SP = "[\\s\\x{00A0}]+"
PUNCT = "[^\\p{L}\\p{N}_\\s\\x{00A0}]"


def squeeze(s: str) -> str:
    return f"trim(regexp_replace({s}, '{SP}', ' ', 'g'))"


def _normalize_sql(column: str) -> str:
    s = f"replace(lower(coalesce({column}, '')), 'ё', 'е')"
    for k, v in text.ABBREVIATIONS.items():
        if "." in k:
            s = f"replace({s}, '{k}', ' {v} ')"
    words = f"string_split({squeeze(f"regexp_replace({s}, '{PUNCT}', ' ', 'g')")}, ' ')"
    case = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ABBREVIATIONS.items()) + " ELSE w END"
    return f"array_to_string(list_transform({words}, lambda w: {case}), ' ')"


@query(f"SELECT doc_id, {_normalize_sql('text')} AS norm FROM documents UNION ALL SELECT -1, {_normalize_sql('raw')} FROM {inline.NAMES.sql()}")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = domain.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))
    return docs.unionByName(inline.NAMES.frame(spark).select(F.lit(-1).cast("long").alias("doc_id"), text.normalize(F.col("raw")).alias("norm")))


@query(f"SELECT raw, array_to_string(list_sort(list_distinct(list_filter(string_split({_normalize_sql('raw')}, ' '), lambda w: w <> ''))), ' ') AS tokens FROM {inline.NAMES.over_sql()}")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return inline.NAMES.over(spark, d).select("raw", F.array_join(text.tokens(F.col("raw")), " ").alias("tokens"))


def _name_sql(column: str) -> str:
    s = f"' ' || regexp_replace(replace(lower(coalesce({column}, '')), 'ё', 'е'), '[\"«»''`]', ' ', 'g') || ' '"
    s = f"regexp_replace(regexp_replace({s}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '[^\\p{{L}}\\p{{N}}_](тоо|ип|ао|оао|зао|клиника|медицинский  центр|мц|гкп)[^\\p{{L}}\\p{{N}}_]', ' ', 'g')"
    return squeeze(f"regexp_replace({s}, '{PUNCT}', ' ', 'g')")


@query(f"SELECT raw, {_name_sql('raw')} AS norm FROM {inline.PARTNERS.sql()} UNION ALL SELECT s_name, {_name_sql('s_name')} FROM supplier")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    rows = inline.PARTNERS.frame(spark).unionByName(domain.partners(spark, d).select(F.col("name").alias("raw")))
    return rows.select("raw", text.normalize_name(F.col("raw")).alias("norm"))


CODE = "nullif(translate(upper(replace(trim({0}), ' ', '')), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX'), '')"


@query(f"SELECT raw, {CODE.format('raw')} AS code FROM {inline.CODES.sql()} UNION ALL SELECT p_brand, {CODE.format('p_brand')} FROM part")
def normalize_code(spark: SparkSession, d: str) -> DataFrame:
    rows = inline.CODES.frame(spark).unionByName(domain.table(spark, d, "part").select(F.col("p_brand").alias("raw")))
    return rows.select("raw", text.normalize_code(F.col("raw")).alias("code"))


def _amount_sql(column: str) -> str:
    m = f"regexp_extract(regexp_replace({column}, '(?i)(тг|тенге|kzt|₸|руб|rub|\\$|usd)\\.?', ' ', 'g'), '[0-9][0-9\\s\\x{{00A0}}\\x{{202F}}.,]*[0-9]|[0-9]', 0)".replace("{{", "{").replace("}}", "}")
    m = f"replace(replace({m}, ' ', ''), chr(160), '')"
    a = f"(SELECT CASE WHEN contains(m, ',') AND contains(m, '.') THEN replace(replace(m, '.', ''), ',', '.') WHEN regexp_matches(m, ',[0-9]{{1,2}}$') THEN replace(m, ',', '.') ELSE replace(m, ',', '') END AS a FROM (SELECT {m} AS m))"
    b = f"(SELECT CASE WHEN length(a) - length(replace(a, '.', '')) > 1 THEN replace(a, '.', '') ELSE a END AS b FROM {a})"
    c = f"(SELECT TRY_CAST(CASE WHEN regexp_full_match(b, '[0-9]+(\\.[0-9]*)?') THEN b END AS DECIMAL(18,5)) AS c FROM {b})"
    return f"(SELECT CASE WHEN c > 0 THEN c END FROM {c})"


@query(f"SELECT raw, {_amount_sql('raw')} AS amount FROM {inline.AMOUNTS.sql()} UNION ALL SELECT raw, {_amount_sql('raw')} FROM (SELECT p_name || ' ' || p_size || ' тг' AS raw FROM part)")
def parse_amount(spark: SparkSession, d: str) -> DataFrame:
    more = domain.table(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_size", F.lit(" тг")).alias("raw"))
    return inline.AMOUNTS.frame(spark).unionByName(more).select("raw", money.parse_amount(F.col("raw")).alias("amount"))


def _kind_sql(column: str) -> str:
    has = lambda words: f"regexp_matches(lower(coalesce({column}, '')), '{'|'.join(words)}')"
    return f"CASE WHEN {has(money.NONRESIDENT)} THEN 'nonresident' WHEN {has(money.INSURANCE)} THEN 'insurance' WHEN {has(money.RESIDENT)} THEN 'resident' ELSE 'other' END"


@query(f"SELECT label, {_kind_sql('label')} AS kind FROM {inline.LABELS.over_sql()}")
def classify_label(spark: SparkSession, d: str) -> DataFrame:
    return inline.LABELS.over(spark, d).select("label", money.classify_label(F.col("label")).alias("kind"))


def _tariffs_sql(rows: str, key: str) -> str:
    return f"""WITH p AS (SELECT *, {_amount_sql('raw')} AS a, {_kind_sql('label')} AS kind FROM {rows}), k AS (SELECT * FROM p WHERE a IS NOT NULL),
  f AS (SELECT {key}, coalesce(arg_min(a, pos) FILTER (kind = 'resident'), arg_min(a, pos)) AS resident, arg_min(a, pos) FILTER (kind = 'nonresident') AS nonres, count(*) AS n, string_agg(label || ': ' || a, ' | ' ORDER BY pos) AS raw_label FROM k GROUP BY {key}),
  r AS (SELECT {', '.join('f.' + c for c in key.split(', '))}, max(a) AS rest FROM f JOIN k USING ({key}) WHERE a <> resident GROUP BY {', '.join('f.' + c for c in key.split(', '))})
  SELECT {key}, resident, coalesce(nonres, CASE WHEN n > 1 THEN rest END) AS nonresident, raw_label FROM (SELECT DISTINCT {key} FROM p) LEFT JOIN f USING ({key}) LEFT JOIN r USING ({key})"""


def _prices(spark: SparkSession, d: str) -> DataFrame:
    rows = inline.PRICES.over(spark, d).withColumn("amount", money.parse_amount(F.col("raw")))
    lists = rows.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "amount"))).alias("p"))
    return lists.select("id", "name", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("amount"))).alias("prices"))


@query(_tariffs_sql(inline.PRICES.over_sql(), "id, name"))
def apply_tariffs(spark: SparkSession, d: str) -> DataFrame:
    t = money.apply_tariffs(F.col("prices"))
    return _prices(spark, d).withColumn("t", t).select("id", "name", "t.resident", "t.nonresident", "t.raw_label")


EXPANDED = f"""(SELECT e.id, CASE WHEN both_ THEN CASE WHEN contains(lower(label), 'первичн') THEN name || ' (первичный приём)' ELSE name || ' (повторный приём)' END ELSE name END AS name, pos, label, raw FROM {inline.PRICES.over_sql()} e
  JOIN (SELECT id, bool_or(contains(lower(label), 'первичн')) AND bool_or(contains(lower(label), 'повторн')) AS both_ FROM {inline.PRICES.over_sql()} GROUP BY id) b ON e.id = b.id
  WHERE NOT both_ OR contains(lower(label), 'первичн') OR contains(lower(label), 'повторн'))"""


@query(_tariffs_sql(EXPANDED, "id, name"))
def expand_primary_repeat(spark: SparkSession, d: str) -> DataFrame:
    rows = _prices(spark, d).select("id", F.explode(money.expand_primary_repeat(F.col("name"), F.col("prices"))).alias("r"))
    return rows.withColumn("t", money.apply_tariffs(F.col("r.prices"))).select("id", "r.name", "t.resident", "t.nonresident", "t.raw_label")


def _quality_sql(rows: str) -> str:
    anchors = " + ".join(f"CAST(contains(lower(b), '{a}') AS INTEGER)" for a in text.QUALITY_ANCHORS)
    return f"""SELECT id, length(b) AS char_count, round(r, 6) AS cyrillic_ratio, round(t, 6) AS contamination, h AS anchor_hits,
  length(regexp_replace(b, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')) < 40 OR r < 0.45 AND h < 2 OR t > 0.18 AND h < 3 AS is_corrupt FROM (
  SELECT id, b, CASE WHEN c + l = 0 THEN 0.0 ELSE CAST(c AS DOUBLE) / (c + l) END AS r, CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(len(list_filter(w, lambda x: regexp_matches(x, '[a-zA-Z]'))) AS DOUBLE) / len(w) END AS t, h FROM (
  SELECT id, b, len(regexp_extract_all(b, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(b, '[a-zA-Z]')) AS l, list_filter(regexp_extract_all(b, '[А-Яа-яЁёA-Za-z]{{2,}}'), lambda x: regexp_matches(x, '[а-яёА-ЯЁ]')) AS w, {anchors} AS h
  FROM (SELECT id, coalesce(body, '') AS b FROM {rows})))"""


@query(_quality_sql(f"(SELECT * FROM {inline.PAGES.sql()} UNION ALL SELECT doc_id + 100, text FROM documents)"))
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = inline.PAGES.frame(spark).unionByName(domain.table(spark, d, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("body")))
    q = rows.select("id", text.text_quality(F.col("body")).alias("q"))
    return q.select("id", F.col("q.char_count").cast("long").alias("char_count"), F.round("q.cyrillic_ratio", 6).alias("cyrillic_ratio"), F.round("q.contamination", 6).alias("contamination"), "q.anchor_hits", "q.is_corrupt")


@query(f"""SELECT name, CASE WHEN f <> '' THEN upper(substr(f, 1, 1)) || lower(substr(f, 2)) ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') END AS partner FROM (SELECT name, regexp_extract(name, '(?i)(клиника\\s*\\d+)', 1) AS f FROM {inline.FILES.over_sql()})""")
def partner_from_filename(spark: SparkSession, d: str) -> DataFrame:
    return inline.FILES.over(spark, d).select("name", text.partner_from_filename(F.col("name")).alias("partner"))


@query(f"""SELECT name, coalesce(TRY_CAST(CASE WHEN f <> '' THEN regexp_extract(f, '(20\\d\\d)$', 1) || '-' || lpad(regexp_extract(f, '^\\d+[.\\-_](\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(f, '^(\\d+)', 1), 2, '0') END AS DATE),
  TRY_CAST(coalesce(nullif(regexp_extract(name, '20\\d\\d'), ''), nullif(regexp_extract(substr(body, 1, 2000), '20\\d\\d'), '')) || '-01-01' AS DATE)) AS effective_date
  FROM (SELECT *, regexp_extract(name, '\\d{{1,2}}[.\\-_]\\d{{1,2}}[.\\-_]20\\d\\d') AS f FROM {inline.FILES.over_sql()})""")
def effective_date(spark: SparkSession, d: str) -> DataFrame:
    return inline.FILES.over(spark, d).select("name", files.effective_date(F.col("name"), F.col("body")).alias("effective_date"))


@query(f"""SELECT name, CASE WHEN e = 'pdf' OR head = '25504446' THEN 'pdf' WHEN e IN ('docx', 'xlsx', 'xls') THEN e WHEN head = '504B0304' THEN 'xlsx' WHEN head = 'D0CF11E0' THEN 'xls' END AS file_format
  FROM (SELECT *, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS e FROM {inline.FILES.over_sql()})""")
def detect_format(spark: SparkSession, d: str) -> DataFrame:
    return inline.FILES.over(spark, d).select("name", files.detect_format(F.col("name"), files.magic(F.unhex("head"))).alias("file_format"))


@query(f"SELECT amount, currency, CASE WHEN currency = 'USD' THEN CAST(round_even(amount * 475.0, 2) AS DECIMAL(14,2)) ELSE amount END AS kzt FROM {inline.FX.over_sql()}")
def fx_convert(spark: SparkSession, d: str) -> DataFrame:
    return inline.FX.over(spark, d).select("amount", "currency", money.convert_to_kzt(F.col("amount"), F.col("currency")).alias("kzt"))


@query(f"""WITH v AS (SELECT *, trim(coalesce(name, '')) <> '' AS ok, list_filter([CASE WHEN resident IS NULL AND nonresident IS NULL AND original IS NULL THEN 'Не распознана цена' END,
  CASE WHEN resident <= 0 THEN 'Цена не положительное число: ' || resident END, CASE WHEN nonresident <= 0 THEN 'Цена не положительное число: ' || nonresident END, CASE WHEN original <= 0 THEN 'Цена не положительное число: ' || original END,
  CASE WHEN resident > 0 AND nonresident > 0 AND nonresident < resident THEN 'Цена нерезидента меньше цены резидента' END, CASE WHEN effective > DATE '2026-01-01' THEN 'Дата прайса в будущем: ' || effective END,
  CASE WHEN currency <> '' AND currency <> 'KZT' THEN 'Валюта ' || currency || ': конвертация по курсу' END], lambda m: m IS NOT NULL) AS m FROM {inline.VALIDATION.over_sql()})
  SELECT id, ok, ok AND len(m) > 0 AS needs_review, CASE WHEN ok THEN array_to_string(m, '|') ELSE 'Пустое название услуги, строка пропущена' END AS messages FROM v""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("name", "resident", "nonresident", "original", "effective", "currency")]
    v = inline.VALIDATION.over(spark, d).select("id", money.validation(*c, F.lit("2026-01-01").cast("date")).alias("v"))
    return v.select("id", "v.ok", "v.needs_review", F.array_join("v.messages", "|").alias("messages"))


@query(f"SELECT items, review, CASE WHEN coalesce(items, 0) <= 0 THEN 'error' WHEN review > 0 THEN 'needs_review' ELSE 'done' END AS status FROM {inline.STATUS.over_sql()}")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    return inline.STATUS.over(spark, d).withColumn("status", money.document_status(F.col("items"), F.col("review")))


@query("SELECT p_partkey AS id, sha256('emb:m:' || p_name) AS emb, sha256('rerank:m:' || p_name || '::' || p_type || '||' || p_brand) AS rerank FROM part")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return domain.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.cache_key("emb", "m", F.col("p_name")).alias("emb"), text.cache_key("rerank", "m", F.col("p_name"), F.array("p_type", "p_brand")).alias("rerank"))


@query(f"""SELECT id, coalesce(TRY_CAST(json_extract_string(j, '$.choice') AS INTEGER), 0) AS choice, coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.0) AS confidence, coalesce(json_extract_string(j, '$.reason'), '') AS reason
  FROM (SELECT id, TRY_CAST(CASE WHEN json_valid(f) THEN f END AS JSON) AS j FROM (SELECT id, regexp_extract(answer, '(?s)\\{{.*\\}}', 0) AS f FROM {inline.ANSWERS.over_sql()}))""")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return inline.ANSWERS.over(spark, d).select("id", text.verdict(F.col("answer")).alias("v")).select("id", "v.*")


@query(f"SELECT raw, trim(regexp_replace(replace(replace(raw, 'иен', 'цен'), 'Иен', 'Цен'), '[ \\t]+', ' ', 'g')) AS fixed FROM {inline.CELLS.over_sql()}")
def ocr_postprocess(spark: SparkSession, d: str) -> DataFrame:
    return inline.CELLS.over(spark, d).select("raw", text.ocr_postprocess(F.col("raw")).alias("fixed"))


@query(f"SELECT name, array_to_string(s, '|') AS synonyms, trim(name || ' ' || array_to_string(s, ' ')) AS embedding_text FROM (SELECT name, list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)), lambda x: x <> '') AS s FROM {inline.SYNONYMS.over_sql()})")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    rows = inline.SYNONYMS.over(spark, d).withColumn("s", text.split_synonyms(F.col("raw")))
    return rows.select("name", F.array_join("s", "|").alias("synonyms"), text.embedding_text(F.col("name"), F.col("s")).alias("embedding_text"))


@query(f"""SELECT raw, CASE WHEN r = '' OR regexp_matches(lower(r), '^\\s*({'|'.join(u.replace('.', chr(92) + '.') for u in text.QUANTITY_UNITS)})') THEN raw ELSE trim(r) END AS name FROM (SELECT raw, regexp_extract(raw, '^\\s*[0-9]{{1,3}}[.)]?\\s+([^0-9].*)$', 1) AS r FROM {inline.CELLS.over_sql()})""")
def strip_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return inline.CELLS.over(spark, d).select("raw", text.strip_enumeration(F.col("raw")).alias("name"))


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


@query(f"""SELECT raw, coalesce({_amount_sql('raw')} IS NOT NULL AND ({_count("regexp_replace(raw, '(?i)тенге|тг|kzt|руб|rub|usd|₸|\\$', '', 'g')", '\\p{L}')} <= 2 OR coalesce({_amount_sql("regexp_extract(raw, '^\\s*([0-9][0-9\\s.,]*)', 1)")}, 0) >= 100), FALSE) AS price,
  t <> '' AND NOT contains(t, ' ') AND length(t) <= 24 AND regexp_matches(t, '\\p{{Nd}}') AND (regexp_matches(t, '\\p{{L}}') OR {_count('t', '[./-]')} >= 2) AS code,
  NOT regexp_matches(t, '^[(<\\[\\-—.,:;]') AND NOT regexp_matches(t, '[,(/\\-]$') AND NOT regexp_matches(t, '\\p{{Nd}}') AND l >= 5 AND (len(w) <= 1 OR len(list_filter(w, lambda x: length(x) >= 6)) > 0) AND (u >= 0.9 * l OR u > 0.7 * l AND length(t) >= 12) AS section,
  regexp_matches(lower(raw), '^({'|'.join(geometry.SECTIONS)})') OR contains(lower(raw), 'договор') OR regexp_matches(raw, '[0-9]{{2}}[.,][0-9]{{2}}[.,][0-9]{{4}}') AS preamble
  FROM (SELECT raw, t, {_count('t', '\\p{L}')} AS l, {_count('t', '\\p{Lu}')} AS u, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: regexp_matches(x, '\\p{{L}}')) AS w FROM (SELECT raw, trim(raw) AS t FROM {inline.CELLS.over_sql()}))""")
def cell_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("raw")
    return inline.CELLS.over(spark, d).select(
        "raw", geometry.looks_like_price(c).alias("price"), geometry.looks_like_code(c).alias("code"), geometry.is_section_heading(c).alias("section"), geometry.is_preamble(c).alias("preamble")
    )


@query(f"""WITH s AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY pos) AS a FROM {inline.SERIES.over_sql()})
  SELECT id, count(*) >= 3 AND bool_and(v = floor(v) AND v BETWEEN 0 AND 100000) AND count(*) FILTER (a IS NOT NULL AND (v = a + 1 OR v BETWEEN 1 AND 3 AND v < a)) / (count(*) - 1) > 0.7 AS is_index FROM s GROUP BY id""")
def index_sequence(spark: SparkSession, d: str) -> DataFrame:
    lists = inline.SERIES.over(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return lists.select("id", geometry.is_index_sequence(F.transform("p", lambda x: x["v"])).alias("is_index"))


@query(f"""WITH c AS (SELECT *, last_value(CASE WHEN NOT priced AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS category FROM {inline.TABLE.over_sql()}) SELECT doc_id, row, text, category FROM c WHERE priced""")
def category_ffill(spark: SparkSession, d: str) -> DataFrame:
    return geometry.category_fill(inline.TABLE.over(spark, d)).drop("priced")


@query(f"""WITH h AS (SELECT doc_id, row, {' + '.join(f"CAST(contains(lower(text), '{a}') AS INTEGER)" for a in geometry.HEADER_ANCHORS)} AS hits FROM {inline.TABLE.over_sql()} WHERE row < 25),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, row) AS k FROM h) SELECT doc_id, CASE WHEN hits >= 2 THEN row ELSE -1 END AS header, hits FROM b WHERE k = 1""")
def find_header(spark: SparkSession, d: str) -> DataFrame:
    return geometry.find_header(inline.TABLE.over(spark, d))


#: Positioned words of a page per order, a line per item: name, code and price.
WORDS = """words AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS line, 'w' || l_partkey AS text, 10.0::DOUBLE + l_linenumber % 3 AS x0, 70.0::DOUBLE + l_linenumber % 3 AS x1, l_linenumber * 12.0::DOUBLE AS top, l_linenumber * 12.0::DOUBLE + 8 + l_linenumber % 2 AS bottom FROM lineitem
  UNION ALL SELECT l_orderkey, 1, l_linenumber, 'c' || l_suppkey, 110.0, 150.0 + l_linenumber % 5, l_linenumber * 12.0 + 1, l_linenumber * 12.0 + 9 FROM lineitem
  UNION ALL SELECT l_orderkey, 1, l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), 200.0, 230.0 + CAST(floor(l_quantity) AS BIGINT) % 10, l_linenumber * 12.0, l_linenumber * 12.0 + 10 FROM lineitem)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("double")
    kind = lambda text, x0, x1, top, bottom: F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.alias("top"), bottom.alias("bottom"))
    words = F.array(
        kind(F.concat(F.lit("w"), "l_partkey"), 10 + n % 3, 70 + n % 3, n * 12, n * 12 + 8 + n % 2),
        kind(F.concat(F.lit("c"), "l_suppkey"), F.lit(110), 150 + n % 5, n * 12 + 1, n * 12 + 9),
        kind(F.floor("l_extendedprice").cast("long").cast("string"), F.lit(200), 230 + F.floor("l_quantity") % 10, n * 12, n * 12 + 10),
    )
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.explode(words).alias("w")).select("doc_id", "page", "line", "w.*")


BOUNDS = f"""WITH {WORDS}, e AS (SELECT DISTINCT doc_id, page, x0, x1 FROM words), m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
  bounds AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) - 1 AS "column", x0 AS bound FROM m WHERE r IS NULL OR x0 - r >= 18)"""


@query(f"{BOUNDS} SELECT * FROM bounds")
def cluster_columns(spark: SparkSession, d: str) -> DataFrame:
    return geometry.cluster_columns(_words(spark, d)).withColumn("column", F.col("column").cast("long"))


@query(f"""{BOUNDS}, a AS (SELECT w.doc_id, w.page, w.line, w.text, w.x0, greatest(0, (SELECT count(*) FROM bounds b WHERE b.doc_id = w.doc_id AND b.page = w.page AND b.bound <= (w.x0 + w.x1) / 2) - 1) AS "column" FROM words w)
  SELECT doc_id, page, line, "column", string_agg(text, ' ' ORDER BY x0, text) AS cell FROM a GROUP BY 1, 2, 3, 4""")
def assign_cells(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return geometry.assign_cells(words, geometry.cluster_columns(words)).withColumn("column", F.col("column").cast("long"))


@query(f"""WITH {WORDS}, s AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi, count(DISTINCT line) AS n_lines FROM words GROUP BY 1, 2), g AS (SELECT *, CAST(trunc((hi - lo) / 2) AS BIGINT) + 1 AS bins FROM s),
  c AS (SELECT DISTINCT w.doc_id, w.page, w.line, unnest(range(CAST(trunc((x0 - lo) / 2) AS BIGINT), least(bins - 1, CAST(trunc((x1 - lo) / 2) AS BIGINT)) + 1)) AS bin FROM words w JOIN g ON w.doc_id = g.doc_id AND w.page = g.page),
  k AS (SELECT doc_id, page, bin, count(*) AS n FROM c GROUP BY 1, 2, 3), e AS (SELECT doc_id, page, lo, n_lines, unnest(range(bins)) AS bin FROM g),
  t AS (SELECT e.*, coalesce(k.n, 0) <= greatest(1, floor(0.08 * greatest(1, n_lines))) AS street FROM e LEFT JOIN k ON e.doc_id = k.doc_id AND e.page = k.page AND e.bin = k.bin),
  z AS (SELECT *, max(CASE WHEN NOT street THEN bin END) OVER (PARTITION BY doc_id, page ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t)
  SELECT doc_id, page, lo + bin * 2 AS bound FROM z WHERE NOT street AND bin - 1 - coalesce(p, -1) >= 5 AND bin * 2 >= 10 UNION SELECT doc_id, page, lo FROM s""")
def density_bounds(spark: SparkSession, d: str) -> DataFrame:
    return geometry.density_bounds(_words(spark, d))


@query(f"""WITH {WORDS}, h AS (SELECT doc_id, page, list_sort(list(bottom - top) FILTER (bottom > top)) AS h FROM words GROUP BY 1, 2) SELECT doc_id, page, CASE WHEN len(h) = 0 THEN 16.0 ELSE greatest(h[len(h) // 2 + 1] * 2.2, 12.0) END AS gap FROM h""")
def line_gap_limit(spark: SparkSession, d: str) -> DataFrame:
    return geometry.line_gap(_words(spark, d))


@query(f"""WITH RECURSIVE {WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(top, 0), x0, top) AS o FROM words),
  f AS (SELECT doc_id, page, [arg_min(top, o)] AS tops FROM o GROUP BY 1, 2
    UNION ALL SELECT f.doc_id, f.page, list_append(any_value(f.tops), arg_min(o.top, o.o)) FROM f JOIN o ON f.doc_id = o.doc_id AND f.page = o.page WHERE len(list_filter(f.tops, lambda t: abs(t - o.top) <= 3.0)) = 0 GROUP BY f.doc_id, f.page),
  b AS (SELECT doc_id, page, arg_max(tops, len(tops)) AS tops FROM f GROUP BY 1, 2)
  SELECT w.doc_id, w.page, text, x0, x1, top, bottom, CAST(list_position(list_sort(tops), list_filter(tops, lambda t: abs(t - top) <= 3.0)[1]) - 1 AS INTEGER) AS line FROM words w JOIN b ON w.doc_id = b.doc_id AND w.page = b.page""")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    return geometry.group_rows(_words(spark, d).drop("line"))


@query()
def stitch_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("p"), F.min("l_extendedprice").alias("x"))
    priced = F.col("line") % 3 == 2
    cells = rows.select(
        "doc_id", F.lit(1).alias("page"), "line", (F.col("line") * 12.0).alias("top"), F.when(~priced, F.concat(F.lit("part "), "p")).alias("name"),
        F.when(F.col("line") % 3 == 1, F.concat(F.lit("c"), "p")).alias("code"), F.when(priced, F.floor("x").cast("string")).alias("price"), F.lit(20.0).alias("gap"),
    )
    return geometry.stitch_rows(cells)

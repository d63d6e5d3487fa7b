"""Matching of raw service names to the catalogue: code, exact, fuzzy and vector levels, gates and decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenprice.functions import text
from lumenprice.operators.blocks import top
from lumenprice.operators.fuzzy import nearest_entries
from lumenprice.operators.neighbours import nearest
from lumenprice.operators.similarity import partial_ratio, ratio, sorted_tokens
from lumenprice.sources.stored import stored

# Fixed values of the contract.
HIGH, LOW, FUZZY_AUTO = 0.85, 0.40, 0.92
LEXICAL, VECTORS, POOL, STORED, ARBITER = 20, 45, 50, 10, 5
CODE_UNIQUE, CODE_LEAST = 0.98, 0.95
VERDICT = "item_id string, choice int, confidence double"


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def lexical_index(services: DataFrame) -> DataFrame:
    """One row per name and synonym of active services: service_id, entry (normalised), seq (the name first)."""
    names = F.array("service_name") if "synonyms" not in services.columns else F.concat(F.array("service_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = services.filter("is_active").select("service_id", F.posexplode(names).alias("seq", "raw"))
    return rows.withColumn("entry", text.normalize(F.col("raw"))).filter("entry <> ''").drop("raw")


def exact_match(names: DataFrame, index: DataFrame) -> DataFrame:
    """names (name) with the first service, by service_id, whose name or synonym normalises alike; a name is normalised once."""
    first = index.groupBy("entry").agg(F.min("service_id").alias("service_id"))
    forms = names.select("name").distinct().withColumn("entry", text.normalize(F.col("name"))).join(first, "entry").select("name", "service_id")
    return names.join(forms, "name", "left").select(*names.columns, "service_id")


def code_hits(rows: DataFrame, services: DataFrame) -> DataFrame:
    """rows (code) with how many active services have their normalised code, and the service if it is one."""
    by_code = services.filter("is_active").withColumn("key", text.normalize_code(F.col("icd_code"))).filter("key is not null")
    hits = by_code.groupBy("key").agg(F.count_distinct("service_id").alias("hits"), F.min("service_id").alias("first"))
    found = rows.withColumn("key", text.normalize_code(F.col("code"))).join(hits, "key", "left")
    return found.select(
        *rows.columns, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("first")).alias("service_id"),
        F.when(F.col("hits") == 1, F.lit(CODE_UNIQUE)).alias("score"),
    )


def fuzzy_top(names: DataFrame, index: DataFrame, limit: int = LEXICAL) -> DataFrame:
    """For each distinct name (name) the best services by string similarity: name, service_id, score, rank.

    Entries are ranked by the ratio of sorted tokens and cut at twice the limit; of these each service's
    best entry counts, and the score is the larger of that ratio and its mean with the partial ratio.
    """
    queries = names.select("name").distinct().withColumn("entry_of", text.normalize(F.col("name")))
    rated = nearest_entries(queries, index, 2 * limit)
    own = stored(top(rated, 1, ["entry_of", "service_id"], [F.col("ts").desc(), "seq"]).drop("rank"), "fuzzy-own")

    @F.pandas_udf("double")
    def partial(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(x, y) for x, y in zip(a, b)])

    pairs = own.select("entry_of", "entry").distinct().withColumn("partial", partial("entry_of", "entry"))
    scored = own.join(pairs, ["entry_of", "entry"]).withColumn("score", F.round(F.greatest(F.col("ts"), 0.5 * F.col("ts") + 0.5 * F.col("partial")) / 100, 6))
    best = top(scored, limit, ["entry_of"], [F.col("score").desc(), "service_id"])
    return queries.join(best, "entry_of").select("name", "service_id", "score", "rank")


def vector_top(queries: DataFrame, catalog: DataFrame, k: int = VECTORS) -> DataFrame:
    """The k rows of largest cosine of each query: query_id, id, score (not below 0), rank. Both have id and embedding.

    A query isn't its own neighbour; null, empty and zero vectors take no part.
    """
    return nearest(queries, catalog, k)


def merge_candidates(lexical: DataFrame, semantic: DataFrame, pool: int = POOL) -> DataFrame:
    """The best score per item and service of both lists (item_id, service_id, score, method); lexical wins ties; the pool's best."""
    both = lexical.withColumn("src", F.lit(0)).unionByName(semantic.withColumn("src", F.lit(1)))
    best = both.groupBy("item_id", "service_id").agg(F.max_by(F.struct("score", "method", "src"), F.struct("score", -F.col("src"))).alias("b"))
    rows = best.select("item_id", "service_id", "b.score", "b.method", "b.src")
    return top(rows, pool, ["item_id"], [F.col("score").desc(), "src", "service_id"]).drop("src")


def gate(score: Column, method: Column) -> Column:
    """auto (matched without review), arbiter (to be decided) or review."""
    return F.when((method == "fuzzy") & (score >= FUZZY_AUTO) | (score >= HIGH), "auto").when(score >= LOW, "arbiter").otherwise("review")


def apply_match(rows: DataFrame) -> DataFrame:
    """What a match does to an item: rows have service, score, method, arbiter ('yes', 'no' or null), candidates (number) and was_verified."""
    sure = F.col("service").isNotNull() & ((F.col("score") >= HIGH) | F.coalesce(F.col("arbiter") == "yes", F.lit(False)))
    said_no = F.coalesce(F.col("arbiter") == "no", F.lit(False))
    return rows.withColumns(
        {
            "service_id": F.col("service"), "match_confidence": F.col("score"), "match_method": F.col("method"),
            "needs_review": F.when(sure, False).when(F.col("service").isNotNull(), True).when(said_no, False).otherwise(F.col("candidates") > 0),
            "is_verified": F.when(sure, F.col("method").isin("exact", "llm")).otherwise(F.col("was_verified")),
        }
    ).drop("service", "score", "method")


def code_level(hits: DataFrame, services: DataFrame) -> DataFrame:
    """item_id, service_id, score, method of hits (code_hits with item_id and name) whose code some services have: of several, the most similar of their names."""
    by_code = hits.filter("hits = 1").select("item_id", "service_id", "score", F.lit("code").alias("method"))
    several = hits.filter("hits > 1").select("item_id", F.coalesce("name", F.lit("")).alias("name"), "code")
    forms = several.select("name", "code").distinct().select("name", "code", text.normalize(F.col("name")).alias("entry"), text.normalize_code(F.col("code")).alias("key"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(sorted_tokens(x), sorted_tokens(y)) / 100 for x, y in zip(a, b)])

    rated = code_pairs(forms, services).withColumn("sim", alike("entry", "other"))
    winner = rated.groupBy("entry", "key").agg(F.max_by(F.struct("sid", "sim"), F.struct("sim", -F.col("sid"))).alias("w"))
    of_form = forms.join(winner, ["entry", "key"]).select("name", "code", "w")
    by_several = several.join(of_form, ["name", "code"]).select("item_id", F.col("w.sid").alias("service_id"), F.greatest(F.lit(CODE_LEAST), F.col("w.sim")).alias("score"), F.lit("code").alias("method"))
    return by_code.unionByName(by_several)


def code_pairs(forms: DataFrame, services: DataFrame) -> DataFrame:
    """key, entry, other, sid: each form (entry, key) beside the distinct names of active services with its code; of alike names the smallest service_id (sid) counts."""
    coded = services.filter("is_active").select(F.col("service_id").alias("sid"), text.normalize_code(F.col("icd_code")).alias("key"), F.col("service_name").alias("raw"))
    names = coded.filter("key is not null").groupBy("key", "raw").agg(F.min("sid").alias("sid")).withColumn("other", text.normalize(F.col("raw")))
    return forms.select("entry", "key").distinct().join(names.groupBy("key", "other").agg(F.min("sid").alias("sid")), "key")


def pooled(names: DataFrame, services: DataFrame, semantic: DataFrame | None = None, reranked: DataFrame | None = None) -> DataFrame:
    """Candidates of distinct names (name): item_id (the name), service_id, score, method, rank (from 0), lexical (the best fuzzy score).

    A name that the fuzzy level settles keeps its fuzzy candidates alone; else semantic neighbours are merged in, and reranked where the provider answered both.
    """
    found = stored(fuzzy_top(names, lexical_index(services)).select(F.col("name").alias("item_id"), "service_id", "score", F.lit("fuzzy").alias("method"), "rank"), "cascade-fuzzy")
    best = found.filter("rank = 0").select("item_id", F.col("score").alias("lexical"))
    pool = found
    if semantic is not None:
        settled = best.filter(F.col("lexical") >= FUZZY_AUTO).select("item_id")
        near = semantic.select(F.col("name").alias("item_id"), "service_id", "score", F.lit("embedding").alias("method"))
        near = near.join(names.select(F.col("name").alias("item_id")).distinct(), "item_id", "left_semi").join(settled, "item_id", "left_anti")
        pool = stored(merge_candidates(found.drop("rank"), near), "cascade-pool")
        if reranked is not None:
            answers = reranked.withColumnRenamed("name", "item_id").join(near.select("item_id").distinct(), "item_id", "left_semi")
            pool = rerank(pool, answers)
    return pool.join(best, "item_id", "left")


def cascade(items: DataFrame, services: DataFrame, semantic: DataFrame | None = None, verdicts: DataFrame | None = None, reranked: DataFrame | None = None) -> DataFrame:
    """Runs all levels on items (item_id, name, code): item_id, service_id, score, method, arbiter, candidates.

    A cheaper level's match ends an item; only distinct names of what is left reach the fuzzy
    level. semantic and reranked (name, service_id, score) and verdicts (name, choice, confidence: as for arbitrate) are
    tables of providers' answers; without them these levels are skipped.
    """
    hits = stored(code_hits(items, services), "cascade-codes")
    by_code = code_level(hits, services)
    exact = stored(exact_match(hits.filter("hits = 0").select("item_id", "name"), lexical_index(services)), "cascade-exact")
    by_name = exact.filter("service_id is not null").select("item_id", "service_id", F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    rest = exact.filter("service_id is null").select("item_id", "name")
    pool = stored(pooled(rest, services, semantic, reranked), "cascade-candidates")
    judged = arbitrate(pool, nothing(items.sparkSession, VERDICT) if verdicts is None else verdicts.withColumnRenamed("name", "item_id"))
    first = pool.filter("rank = 0").join(pool.groupBy("item_id").agg(F.count(F.lit(1)).alias("candidates")), "item_id")
    sure = (F.col("lexical") >= FUZZY_AUTO) | (F.col("score") >= HIGH)
    auto = first.filter(sure).select("item_id", "service_id", "score", "method", F.lit(None).cast("string").alias("arbiter"), "candidates")
    asked = first.filter(~sure & (F.col("score") >= LOW)).select("item_id", "candidates").join(judged, "item_id")
    low = first.filter(~sure & (F.col("score") < LOW)).select("item_id", F.lit(None).cast("long").alias("service_id"), "score", F.lit("none").alias("method"), F.lit(None).cast("string").alias("arbiter"), "candidates")
    decided = auto.unionByName(asked.select(auto.columns)).unionByName(low).withColumnRenamed("item_id", "name")
    by_rest = rest.join(decided, "name", "left").select("item_id", "service_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("method", F.lit("none")).alias("method"), "arbiter", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    known = by_code.unionByName(by_name).withColumns({"arbiter": F.lit(None).cast("string"), "candidates": F.lit(1).cast("long")})
    return known.unionByName(by_rest)


def manual_match(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items with an operator's decisions (item_id, action: confirm, correct or reject; chosen): sure, verified and not for review."""
    d = F.col("action")
    out = items.join(decisions, "item_id", "left")
    return out.withColumns(
        {
            "service_id": F.when(d == "reject", None).when(d.isNotNull(), F.col("chosen")).otherwise(F.col("service_id")),
            "match_method": F.when(d.isNotNull(), "manual").otherwise(F.col("match_method")),
            "match_confidence": F.when(d == "reject", 0.0).when(d.isNotNull(), 1.0).otherwise(F.col("match_confidence").cast("double")),
            "needs_review": F.when(d.isNotNull(), False).otherwise(F.col("needs_review")),
            "is_verified": d.isNotNull(),
            "note": F.when(d == "reject", "Оператор: совпадения нет").when(d == "confirm", "Оператор подтвердил").when(d == "correct", "Оператор исправил"),
        }
    ).drop("action", "chosen")


def learn_synonyms(services: DataFrame, learned: DataFrame) -> DataFrame:
    """service_id and the synonyms it learns (service_id, raw): raw names that normalise differently from its name and its synonyms (an array, if there is one), one of each form."""
    there = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), text.normalize) if "synonyms" in services.columns else F.array().cast("array<string>")
    own = services.select("service_id", F.array_append(there, text.normalize(F.col("service_name"))).alias("own"))
    rows = learned.withColumn("form", text.normalize(F.col("raw"))).join(own, "service_id")
    first = rows.filter(~F.array_contains("own", F.col("form")) & (F.col("form") != "")).groupBy("service_id", "form").agg(F.min("raw").alias("raw"))
    return first.groupBy("service_id").agg(F.array_sort(F.collect_list("raw")).alias("synonyms"))


def rematch_kpis(items: DataFrame) -> DataFrame:
    """Counts and shares of a matching run over items (service_id, needs_review, method)."""
    n, auto = F.count(F.lit(1)), F.count_if(F.col("service_id").isNotNull())
    out = items.agg(n.alias("total"), auto.alias("auto"), F.count_if("needs_review").alias("review"), F.count_if(F.col("service_id").isNull() & ~F.col("needs_review")).alias("unmatched"))
    return out.withColumn("auto_pct", F.round(F.coalesce(F.try_divide(F.col("auto") * 100.0, "total"), F.lit(0.0)), 2))


def bands(score: Column) -> Column:
    return F.when(score >= 0.95, "0.95+").when(score >= HIGH, "0.85-0.95").when(score >= 0.6, "0.60-0.85").when(score >= LOW, "0.40-0.60").otherwise("<0.40")


def arbiter_pending(band: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys of the band's distinct questions (cache_key) that the cache has no answer to."""
    return band.select("cache_key").distinct().join(cache, "cache_key", "left_anti")




def rerank(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """candidates (item_id, service_id, score, method, rank) with a reranker's answers (item_id, service_id, score).

    A row with an answer has the higher of both scores and the method rerank; ranks follow the scores, and of equal
    ones the ranks before. An item of a single candidate isn't reranked.
    """
    said = answers.select("item_id", "service_id", F.col("score").alias("said"))
    many = F.count(F.lit(1)).over(Window.partitionBy("item_id")) > 1
    rows = candidates.join(said, ["item_id", "service_id"], "left").withColumn("said", F.when(many, F.col("said")))
    rows = rows.withColumns({"score": F.greatest("score", "said"), "method": F.when(F.col("said").isNotNull(), "rerank").otherwise(F.col("method"))})
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "rank")) - 1
    return rows.withColumn("rank", rank).drop("said")


def arbitrate(candidates: DataFrame, answers: DataFrame, asked: int = 5) -> DataFrame:
    """item_id, service_id, score, method, arbiter of the items whose best candidate an arbiter has to judge.

    answers: item_id, choice (from 1 in rank order; anything else is no) and confidence. Without an answer the method is none
    and the arbiter null.
    """
    best = candidates.filter("rank = 0").filter((F.col("score") >= LOW) & (F.col("score") < HIGH)).select("item_id", F.col("score").alias("best"))
    picked = candidates.filter(F.col("rank") < asked).select("item_id", (F.col("rank") + 1).alias("choice"), "service_id", "score")
    rows = best.join(answers, "item_id", "left").join(picked, ["item_id", "choice"], "left")
    yes = F.col("service_id").isNotNull()
    return rows.select(
        "item_id", "service_id", F.when(yes, F.greatest("score", "confidence")).otherwise(F.col("best")).alias("score"),
        F.when(yes, "llm").otherwise("none").alias("method"), F.when(yes, "yes").when(F.col("choice").isNotNull(), "no").alias("arbiter"),
    )


def accuracy(items: DataFrame, services: DataFrame, outcomes: DataFrame) -> DataFrame:
    """checked, correct and share of an arbiter's matches (item_id, service_id, method) of items whose code names one service."""
    codes = services.filter("is_active").select(text.normalize_code(F.col("icd_code")).alias("key"), F.col("service_id").alias("truth")).filter("key is not null")
    single = codes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("truth").alias("truth")).filter("n = 1")
    known = items.select("item_id", text.normalize_code(F.col("code")).alias("key")).join(single, "key")
    rows = known.join(outcomes.filter("method = 'llm' and service_id is not null"), "item_id")
    right = F.count_if(F.col("service_id") == F.col("truth"))
    return rows.agg(F.count(F.lit(1)).alias("checked"), right.alias("correct"), F.round(F.try_divide(right * 100.0, F.count(F.lit(1))), 1).alias("share"))

"""The arbiter's answers: distinct questions of a run asked once, in bounded batches, and kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprice.functions import text
from lumenprice.operators.resolve import ARBITER, FUZZY_AUTO, HIGH, LOW
from lumenprice.sources.stored import stored

#: Questions of one call, and of one round whose answers are committed together.
CALL, ROUND = 50, 10_000
ANSWER = "cache_key string, choice int, confidence double"


def questions(pool: DataFrame, services: DataFrame, model: str) -> DataFrame:
    """cache_key, name, candidates (names of the first ARBITER services) of the distinct names in the band that an arbiter has to judge.

    pool: resolve.pooled. A name that no level settles and whose best score is from LOW to below HIGH is in the band.
    """
    band = pool.filter((F.col("rank") == 0) & (F.coalesce("lexical", F.lit(0.0)) < FUZZY_AUTO) & (F.col("score") >= LOW) & (F.col("score") < HIGH)).select("item_id")
    first = pool.filter(F.col("rank") < ARBITER).join(band, "item_id").join(services.select("service_id", "service_name"), "service_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "service_name"))), lambda c: c["service_name"])
    asked = first.groupBy(F.col("item_id").alias("name")).agg(listed.alias("candidates"))
    return asked.select(text.cache_key("llm", model, F.col("name"), F.col("candidates")).alias("cache_key"), "name", "candidates")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The answers at path, none where nothing is there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(ANSWER).parquet(path) if there else spark.createDataFrame([], ANSWER)


def warm(asked: DataFrame, path: str, ask: Callable[[list[dict]], list[dict | None]]) -> int:
    """Asks the questions (cache_key, name, candidates) that path has no answer to, and how many answers came.

    ask gets at most CALL questions as dicts and gives a dict (choice, confidence) or None for each; a call that fails
    answers none of its questions, and the others go on. Every ROUND questions are a job of their own whose answers are
    committed before the next begins, so that a lost job or task asks again only what its own round hadn't committed,
    and a later run asks only what has no answer.
    """
    spark = asked.sparkSession
    pending = stored(asked.dropDuplicates(["cache_key"]).join(cached(spark, path), "cache_key", "left_anti"), "arbiter-pending")
    n, before = pending.count(), cached(spark, path).count()
    rounds = max(1, -(-n // ROUND))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CALL):
                own = batch.slice(i, CALL).to_pylist()
                try:
                    said = ask(own)
                except Exception:  # a provider's failure leaves its questions open
                    continue
                out = [{"cache_key": q["cache_key"], "choice": a.get("choice", 0), "confidence": a.get("confidence", 0.0)} for q, a in zip(own, said) if a is not None]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cache_key", pa.string()), ("choice", pa.int32()), ("confidence", pa.float64())]))

    for i in range(rounds if n else 0):
        part = pending.filter(F.pmod(F.xxhash64("cache_key"), F.lit(rounds)) == i).select("cache_key", "name", "candidates")
        part.repartition(max(1, min(-(-n // (rounds * CALL)), 200)), "cache_key").mapInArrow(answers, ANSWER).write.mode("append").parquet(path)
    return cached(spark, path).count() - before


def verdicts(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """name, choice, confidence for resolve.cascade from questions and their answers."""
    return asked.join(answers, "cache_key").select("name", "choice", "confidence")

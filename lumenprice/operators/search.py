"""Full-text search over stemmed words: an inverted index, written once, and lookups in it."""

from __future__ import annotations

import re
import uuid
import zlib

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenprice.sources.stored import shared_dir

#: Folders of the index.
BUCKETS = 64

# Fixed values of the published Snowball algorithm for Russian: endings by kind.
VOWELS = "аеиоуыэюя"
GERUND = (("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив"))
ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
VERB = (
    ("йте", "ешь", "нно", "ете", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"),
    ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"),
)
NOUN = ("иями", "иях", "ями", "ами", "ией", "иям", "ием", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
STOP = frozenset("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне от о из ему для при".split())


def _cut(word: str, start: int, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """word without its longest ending in the region from start; after_a's endings need а or я before them, which stays."""
    for e in sorted({*free, *after_a}, key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= start:
            if e in free or len(word) - len(e) > start and word[-len(e) - 1] in "ая":
                return word[: -len(e)]
    return None


def stem(word: str) -> str:
    """The stem of a lower-case Russian word; other words stay as they are."""
    word = word.replace("ё", "е")
    found = re.search(f"[{VOWELS}]", word)
    if not found:
        return word
    rv = found.end()
    r1 = re.search(f"[{VOWELS}][^{VOWELS}]", word)
    r2 = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, r1.end()) if r1 else None
    done = _cut(word, rv, GERUND[1], GERUND[0])
    if done is None:
        word = _cut(word, rv, ("ся", "сь")) or word
        done = _cut(word, rv, ADJECTIVE)
        if done is not None:
            done = _cut(done, rv, PARTICIPLE[1], PARTICIPLE[0]) or done
        else:
            done = _cut(word, rv, VERB[1], VERB[0])
            done = done if done is not None else _cut(word, rv, NOUN)
    word = done if done is not None else word
    word = word[:-1] if word.endswith("и") and len(word) > rv else word
    if r2:
        word = _cut(word, r2.end(), ("ость", "ост")) or word
    if word.endswith("нн") and len(word) - 1 > rv:
        return word[:-1]
    word = _cut(word, rv, ("ейше", "ейш")) or word
    if word.endswith("нн"):
        return word[:-1]
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def lexemes(text: str | None) -> list[str]:
    return [stem(w) for w in regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower()) if w not in STOP]


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    return words.map(stem)


def titles(services: DataFrame, partners: DataFrame) -> DataFrame:
    """kind, id, title, category of what a search can find: active services and partners."""
    return services.filter("is_active").select(F.lit("service").alias("kind"), F.col("service_id").alias("id"), F.col("service_name").alias("title"), "category").unionByName(
        partners.filter("is_active").select(F.lit("partner").alias("kind"), F.col("partner_id").alias("id"), F.col("name").alias("title"), F.col("city").alias("category"))
    )


def postings(rows: DataFrame) -> DataFrame:
    """gram, kind, id, title, category, weight: where each stem (as "s:...", weight its occurrences) and three letters (as "t:...") of a title occur.

    Only distinct words go to Python to be stemmed. Null titles have no postings.
    """
    named = rows.filter("title is not null").withColumn("low", F.lower("title"))
    keys = ["kind", "id", "title", "category"]
    words = named.select(*keys, F.explode(F.regexp_extract_all("low", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("word")).filter(~F.col("word").isin(*STOP))
    stems = words.select("word").distinct().withColumn("stem", stem_of("word"))
    by_stem = words.join(stems, "word").groupBy(*keys, F.concat(F.lit("s:"), "stem").alias("gram")).agg(F.count(F.lit(1)).alias("weight"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("low") - 2, F.lit(1)))
    threes = F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(F.col("low"), i, F.lit(3))), lambda g: F.length(g) == 3))
    by_three = named.select(*keys, F.explode(threes).alias("three")).select(*keys, F.concat(F.lit("t:"), "three").alias("gram"), F.lit(0).cast("long").alias("weight"))
    return by_stem.unionByName(by_three).select("gram", *keys, "weight")


def build(rows: DataFrame, path: str) -> None:
    """Writes the inverted index of titles: postings in BUCKETS folders by gram and in its order, and the titles themselves.

    Postings carry their titles, so that a search reads its own grams' rows and joins nothing. Folders of a frequent gram are several files.
    """
    placed = postings(rows).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    rows.write.parquet(f"{path}/titles")


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def lookup(spark: SparkSession, path: str, query: str) -> DataFrame:
    """kind, id, title, category, rank of the titles with every stem of the query, or with the query (an ILIKE pattern) as a part.

    More frequent stems rank higher; what only the pattern finds ranks 0. Stems are read from their buckets alone, and the pattern's candidates
    from the bucket of three letters that each of them must have; only a pattern without such letters reads all titles. A blank query finds nothing.
    """
    shape = "gram string, kind string, id long, title string, category string, weight long, bucket int"
    keys = ["kind", "id", "title", "category"]
    wanted = [f"s:{w}" for w in sorted(set(lexemes(query)))]
    letters = max(re.split(r"[%_\\]", query.lower()), key=len)
    three = [f"t:{letters[:3]}"] if len(letters) >= 3 else []
    grams = wanted + three
    index = spark.read.schema(shape).parquet(f"{path}/postings")
    if not query.strip():
        return index.filter("false").select(*keys, F.lit(0.0).alias("rank"))
    own = index.filter(F.col("bucket").isin(*map(bucket_of, grams)) & F.col("gram").isin(*grams)) if grams else index.filter("false")
    alike = F.col("title").ilike(f"%{query}%")
    if not three:
        text = spark.read.schema("kind string, id long, title string, category string").parquet(f"{path}/titles").filter(alike)
        own = own.select("gram", *keys, "weight").unionByName(text.select(F.lit("t:").alias("gram"), *keys, F.lit(0).cast("long").alias("weight")))
    # a title of equal words may be there twice: one row of an id and title is one hit
    stems = F.count_if(F.col("gram").startswith("s:"))
    found = own.groupBy(*keys).agg(stems.alias("stems"), F.sum("weight").alias("weight")).withColumn("whole", F.lit(bool(wanted)) & (F.col("stems") == len(wanted)))
    return found.filter(F.col("whole") | alike).select(*keys, F.when(F.col("whole"), F.round(0.1 * F.col("weight"), 6)).otherwise(0.0).alias("rank"))


def search_stemmed(services: DataFrame, partners: DataFrame, query: str, folder: str | None = None) -> DataFrame:
    """lookup() in an index that is built for this one search."""
    path = f"{folder or shared_dir(services.sparkSession)}/search-{uuid.uuid4().hex}"
    build(titles(services, partners), path)
    return lookup(services.sparkSession, path, query)

"""Quality rules: base rules, and minimum-covariance-determinant outliers of each language and source (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Base rules: fewest words, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEAT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
#: Share of a pool's rows that the smallest determinant is sought for, and steps of concentration.
SHARE, STEPS = 0.75, 8
#: Rows that a pool needs; smaller ones are pooled by language, then all together.
LEAST_ROWS = 200
#: Chance that a row of a normal pool lies beyond the cut.
TAIL = 1e-6
#: Steps of a transformed statistic: sums of integers are exact, in whatever order rows come.
UNIT = 1024
#: Least spread of each transformed statistic: most statistics are 0 in most rows of a pool.
SPREAD = (0.25, 0.08, 0.2, 0.15, 0.15)
P = len(SPREAD)
#: Bins of distances and statistics a doubling and a unit.
FINE, COARSE = 16, 16
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """How many of the words stand in a window of three words that occurs twice or more.

    Most texts have no two windows of one hash and need no more. In the others each window is written with its place
    behind it and sorted, so that equal ones are neighbours (words hold no blanks): n log n work in a row's words.
    """
    first = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    after = lambda i, k: F.get(words, i + k)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        def starts(windows: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(windows, k) == F.substring_index(x, " ", 3), F.lit(False))
            twice = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return let(F.sort_array(F.transform(twice, lambda x: F.substring_index(x, " ", -1).cast("int"))), covered)

        return let(F.transform(ordered, lambda x: F.substring_index(x, " ", 3)), starts)

    placed = F.transform(first, lambda w, i: F.concat_ws(" ", w, after(i, 1), after(i, 2), i))
    hashes = F.transform(first, lambda w, i: F.xxhash64(w, after(i, 1), after(i, 2)))
    apart = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(apart, 0).otherwise(let(F.sort_array(placed), repeated)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row, over whole texts."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    of_words = let(words, lambda x: F.struct(F.size(x).cast("long").alias("n"), repeat_words(x).alias("r")))
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"))
        .select(
            "doc_id", "lang", "source", of_words.alias("words"),
            F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            of_lines.alias("lines"),
        )
        .select("doc_id", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.d").alias("n_dup_lines"), F.col("words.r").alias("n_repeat_words"))
    )


def transformed() -> list[Column]:
    """The vector that outliers are sought in: size, mean length of words, symbols a word, shares of repeated lines and words; in UNIT steps."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log(n.cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(1 + 10 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def pools(rows: DataFrame) -> DataFrame:
    """key, pool: which rows an estimate for a language and source is taken over; pool is null where too few rows are left for any.

    A language and source with LEAST_ROWS rows is a pool; the smaller ones of a language are one pool together,
    and what is still too small is one pool of all.
    """
    own = rows.groupBy("key", "lang_key").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("small", F.when(F.col("n") < LEAST_ROWS, F.col("n")).otherwise(0))
    left = own.groupBy("lang_key").agg(F.sum("small").alias("rest"))
    left = left.withColumn("least", F.when(F.col("rest") < LEAST_ROWS, F.col("rest")).otherwise(0))
    total = left.agg(F.sum("least").alias("total"))
    both = own.join(left, "lang_key").join(F.broadcast(total))  # one row
    pool = F.when(F.col("small") == 0, F.concat(F.lit("0"), "key")).when(F.col("least") == 0, F.concat(F.lit("1"), "lang_key")).when(F.col("total") >= LEAST_ROWS, F.lit("2"))
    return both.select("key", pool.alias("pool"))


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def moments(summed: DataFrame, *keys: str) -> DataFrame:
    """Means m and covariances c from sums s and q over n rows."""
    means = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)]
    covariances = [((F.col(f"q{i}{j}") / F.col("n")) - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))).alias(f"c{i}{j}") for i, j in PAIRS]
    return summed.select(*keys, *means, *covariances)


def middle(rows: DataFrame) -> DataFrame:
    """Means and covariances to begin with: median and squared quartile range of each statistic in a pool, from counts of COARSE steps."""
    each = rows.select("pool", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / COARSE) for i in range(P)])).alias("i", "bin"))
    counts = each.groupBy("pool", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("pool", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("pool", "i")
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    quartile = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), (F.col("bin") + 0.5) * COARSE))
    of_each = ranked.groupBy("pool", "i").agg(quartile(0.25).alias("low"), quartile(0.5).alias("mid"), quartile(0.75).alias("high"))
    spread = F.pow((F.col("high") - F.col("low")) / (NormalDist().inv_cdf(0.75) * 2), 2)
    at = lambda i, value: F.max(F.when(F.col("i") == i, value))
    return of_each.groupBy("pool").agg(*[at(i, F.col("mid")).alias(f"m{i}") for i in range(P)], *[(at(i, spread) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def factored(estimates: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds l, the Cholesky factor of scale * c with the least spread on its diagonal, and the logarithm of its determinant."""
    out = estimates
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") * scale
        if i == j:
            rest = F.greatest(rest, F.lit(0.0)) + (SPREAD[i] * UNIT) ** 2
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("det", reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(P)]))


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d, the squared Mahalanobis distance of x from m under the factor l."""
    out = rows
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: moments of the SHARE of each pool's rows that lie nearest under each start's estimate.

    Rows are summed up by bins of distance before they are shuffled, so that a pool of any size
    leaves a bounded number of rows a task.
    """
    measured = with_distance(rows.join(factored(estimates), "pool"))
    binned = measured.groupBy("pool", "start", F.floor(FINE * F.log2(1 + F.col("d"))).alias("bin")).agg(*sums())
    inside = Window.partitionBy("pool", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    running = binned.select("pool", "start", F.col("n").alias("own"), F.sum("n").over(Window.partitionBy("pool", "start")).alias("all"), *[F.sum(x).over(inside).alias(x) for x in names])
    edge = (F.col("n") >= SHARE * F.col("all")) & (F.col("n") - F.col("own") < SHARE * F.col("all"))
    return moments(running.filter(edge), "pool", "start")


def chi2_below(x: float, dof: int) -> float:
    """Chance of a chi-square value under x, for an odd number of degrees of freedom."""
    terms, term = 0.0, math.sqrt(x)
    for k in range(1, dof - 1, 2):
        terms += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 / math.pi) * math.exp(-x / 2) * terms


def chi2_at(share: float, dof: int) -> float:
    """The chi-square value that share lies under, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dof) < share else (low, mid)
    return low


#: A normal pool's covariance over that of its nearest SHARE.
CONSISTENT = SHARE / chi2_below(chi2_at(SHARE, P), P + 2)
CUT = chi2_at(1 - TAIL, P)


def judged(docs: DataFrame) -> DataFrame:
    """The base statistics of every row, base_failed, the squared distance d (null where none is asked) and kept.

    docs has doc_id, text, lang and source; other columns don't matter. Null and empty texts have no words and fail the base
    rules, as all rows under LEAST_WORDS words do and those with more than MOST_REPEAT percent of words in repeated windows.
    Null languages and sources are values of their own. Repeated rows count as often as they are there. Rows of a pool
    that has too few rows for an estimate are kept. An empty table gives no rows. Results don't depend on how rows are dealt:
    all sums are of integers.

    Each pool's location and covariance are those of the SHARE of its rows with the smallest determinant
    that STEPS steps of concentration reach from two starts (medians with quartile ranges, and all rows); a row is rejected
    when its squared Mahalanobis distance is above the chi-square value that a share of TAIL of a normal pool exceeds. Rows that
    fail the base rules take no part in estimates. Only Spark's own functions are used.
    """
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    keyed = statistics(docs).select("*", failed.alias("base_failed"), part(F.col("lang")).alias("lang_key"), F.concat(part(F.col("lang")), F.lit("/"), part(F.col("source"))).alias("key"), *transformed())
    rows = staged(keyed, "outlier-rows")
    sound = rows.filter(~F.col("base_failed"))
    of_keys = staged(pools(sound), "outlier-pools")
    inside = staged(sound.select("key", *[f"x{i}" for i in range(P)]).join(of_keys.filter("pool is not null"), "key").drop("key"), "outlier-sound")
    starts = middle(inside).withColumn("start", F.lit(0)).unionByName(moments(inside.groupBy("pool").agg(*sums()), "pool").withColumn("start", F.lit(1)))
    estimates = staged(starts, "outlier-starts")
    for _ in range(STEPS):
        estimates = staged(concentrated(inside, estimates), "outlier-step")
    least = factored(estimates).withColumn("_at", F.row_number().over(Window.partitionBy("pool").orderBy("det", "start"))).filter("_at = 1")
    final = factored(least.select("pool", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]), CONSISTENT)
    known = staged(of_keys.join(final, "pool").drop("pool", "det"), "outlier-final")
    measured = with_distance(rows.join(known, "key", "left"))
    outlier = F.coalesce(F.col("d") > CUT, F.lit(False))
    return measured.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("d")).alias("d"), (~F.col("base_failed") & ~outlier).alias("kept"),
    )

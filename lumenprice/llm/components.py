"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root, where root is the smallest node that is reachable; from edges (a, b) of long ids.

    Each step replaces edges by edges to the smallest neighbour (Kiveris et al., 2014), as joins
    and minimum aggregates: no node's neighbours are gathered in one place. The steps are stored,
    and end when every node but a root has its root as only neighbour. Null ends and loops are left out.
    """
    now = staged(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "edges")
        # small star: smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = large.join(least, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.distinct(), "edges")
        # a forest of stars: no node has two parents, and no parent has a parent
        many = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        deep = 0 if many else now.join(now.select(F.col("a").alias("p")), F.col("b") == F.col("p"), "left_semi").limit(1).count()
        if not many and not deep:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

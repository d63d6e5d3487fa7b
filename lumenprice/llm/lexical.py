"""Ranked lexical search: an index clustered by recursive graph bisection, visited by cluster bounds with exact stopping (operator 11)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bisection import routed, tree
from .common import giving_back, ordered_index, staged
from .vectors import best

#: A term: a maximal match, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8: those of terms (A-Z lower-cased), and blanks for the rest.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once.
PIECE = 4 << 20
#: Most bytes of item terms that are sent to every executor; beyond it terms are joined.
DICTIONARY = 64 << 20
#: The bisection is fitted on about so many documents, on terms dealt to so many features; every document is indexed.
SAMPLE, FEATURES = 16_384, 4_096
#: Most levels, and the fewest documents and sampled ones of a cluster.
LEVELS, LEAST_DOCS, LEAST_SAMPLE = 8, 256, 64
#: Documents of a shard about; a larger cluster is several shards. Items of a block.
SHARD, ITEMS = 4_096, 256
#: Shards an item visits, by falling bound, up to the end of each round.
ROUNDS = (1, 8, None)
HIGH = (1 << 63) - 1


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(f"({TERM})"), F.lit(1))


def counted(text: str | None) -> tuple[int, Counter]:
    """How many terms a text has, and each one's occurrences."""
    data, n, found, at = (text or "").encode("utf-8", "surrogatepass").translate(FOLD), 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        own = data[at : end if end >= 0 else len(data)].split()
        n += len(own)
        found.update(own)
        at = end if end >= 0 else len(data)
    return n, found


def joined(columns: dict, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in schema], names=[name for name, _ in schema])


def with_terms(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """at, doc_id, n (terms of the text), tids and tfs (those in the dictionary, and how often; packed int32) of every document."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(HIGH)).alias("doc_id"), F.col("text").cast("string"))
    size = dictionary.agg(F.sum(F.octet_length("term") + 8).alias("n")).first()["n"] or 0
    schema = [("doc_id", pa.int64()), ("n", pa.int64()), ("tids", pa.binary()), ("tfs", pa.binary())]
    types = "doc_id long, n long, tids binary, tfs binary"
    if size <= DICTIONARY:
        held = docs.sparkSession.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass"): r["tid"] for r in dictionary.collect()})  # DICTIONARY bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = held.value
            for batch in batches:
                out: dict = {name: [] for name, _ in schema}
                for name, text in zip(batch.column(0), batch.column(1)):
                    n, found = counted(text.as_py())
                    known = sorted((ids[t], c) for t, c in found.items() if t in ids)
                    out["doc_id"].append(name.as_py())
                    out["n"].append(n)
                    out["tids"].append(np.array([t for t, _ in known], np.int32).tobytes())
                    out["tfs"].append(np.array([c for _, c in known], np.int32).tobytes())
                yield joined(out, schema)

        found = named.mapInArrow(giving_back(run), types)
        return staged(found.withColumn("at", F.monotonically_increasing_id()), "lexical-terms")

    rows = staged(named.select("doc_id", terms_of(F.col("text")).alias("terms")).withColumn("at", F.monotonically_increasing_id()), "lexical-words")
    each = rows.select("at", F.explode("terms").alias("term")).groupBy("at", "term").agg(F.count(F.lit(1)).alias("tf")).join(dictionary, "term")
    known = each.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("tid", "tf"))).alias("known"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[(k["tid"], k["tf"]) for k in own or []] for own in batch.column(2).to_pylist()]
            columns = {"doc_id": batch.column(0).to_pylist(), "n": batch.column(1).to_pylist(), "tids": [np.array([t for t, _ in x], np.int32).tobytes() for x in lists], "tfs": [np.array([c for _, c in x], np.int32).tobytes() for x in lists]}
            yield joined(columns, schema)

    sized = rows.select("at", "doc_id", F.size("terms").cast("long").alias("n")).join(known, "at", "left")
    return staged(sized.select("doc_id", "n", "known").mapInArrow(packed, types).withColumn("at", F.monotonically_increasing_id()), "lexical-terms")


def csr(cells, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """Packed lists one behind the other, and where each starts."""
    own = [c for c in cells]
    sizes = np.array([len(c) for c in own], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(own), kind), np.cumsum(sizes) - sizes


def document_counts(rows: DataFrame) -> DataFrame:
    """tid and df: how many documents hold each term of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, counts = np.unique(csr(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int32()), pa.array(counts, pa.int64())], names=["tid", "df"])

    return rows.select("tids").mapInArrow(run, "tid int, df long").groupBy("tid").agg(F.sum("df").alias("df"))


def features(cells) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of lists of terms, none of them empty."""
    own = [np.unique(np.frombuffer(c, np.int32) % FEATURES) for c in cells]
    sizes = np.array([len(x) for x in own], np.int64)
    return np.concatenate(own), np.cumsum(sizes) - sizes


def clustered(rows: DataFrame) -> DataFrame:
    """rows that hold a term of the dictionary, with the cluster each goes to by a bisection fitted on about SAMPLE of them."""
    spark = rows.sparkSession
    some = rows.filter(F.octet_length("tids") > 0)
    n = some.count()
    part = min(1.0, SAMPLE / max(n, 1))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(c, np.int32) % FEATURES).astype(np.uint16).tobytes() for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["f"])

    drawn = some.filter(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else some
    sample = [r["f"] for r in drawn.select("tids").mapInArrow(sampled, "f binary").collect()]  # FEATURES numbers of 2 bytes a document at most
    levels = max(0, min(LEVELS, int(np.log2(max(n / LEAST_DOCS, 1))), int(np.log2(max(len(sample) / LEAST_SAMPLE, 1)))))
    terms, starts = csr(sample, np.uint16)
    held = spark.sparkContext.broadcast(tree(terms.astype(np.int64), starts, FEATURES, levels))  # 2^LEVELS * FEATURES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = routed(*held.value, *features(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], names=[*batch.schema.names, "cluster"])

    return staged(some.select("doc_id", "n", "tids", "tfs", "at").mapInArrow(run, "doc_id long, n long, tids binary, tfs binary, at long, cluster long"), "lexical-clustered")


def index(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each shard, about SHARD documents of one cluster: shard, docs, and by term its places, parts of scores and their most.

    A part is what one occurrence of the term in an item adds to a document's score before the term's weight.
    """
    per = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}  # 2^LEVELS rows at most
    shards = F.array(*[F.lit(-(-per.get(c, 1) // SHARD)) for c in range(max(per, default=0) + 1)])
    dealt = rows.withColumn("shard", F.col("cluster") * (1 << 40) + F.pmod(F.xxhash64("at"), F.get(shards, F.col("cluster").cast("int"))))

    def run(own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("doc_id").to_numpy(), kind="stable")
        own = own.take(order)
        tids, starts = csr(own.column("tids").to_pylist())
        tfs = csr(own.column("tfs").to_pylist())[0].astype(np.int64)
        place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tids))))
        m = 100 - 25 + (25 * own.column("n").to_numpy().astype(np.int64) * n_docs) // n_terms
        part = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[place])
        by_term = np.argsort(tids, kind="stable")
        names, first = np.unique(tids[by_term], return_index=True)
        part = part[by_term].astype(np.int32)
        cells = [own.column("doc_id").to_numpy().astype(np.int64), names.astype(np.int32), first.astype(np.int64), place[by_term].astype(np.int32), part, np.maximum.reduceat(part, first)]
        return pa.table({"shard": pa.array([own.column("shard")[0].as_py()], pa.int64()), **{k: pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for k, c in zip(("docs", "tids", "starts", "places", "parts", "tops"), cells)}})

    shape = "shard long, docs binary, tids binary, starts binary, places binary, parts binary, tops binary"
    return staged(dealt.select("doc_id", "n", "tids", "tfs", "shard").groupBy("shard").applyInArrow(run, shape), "lexical-index")


def item_blocks(items: DataFrame, n_items: int) -> DataFrame:
    """A row for each block of about ITEMS items: block, and packed the items' ats, starts, tids and weights."""

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([("item_at", "ascending"), ("tid", "ascending")])
        ats, starts = np.unique(own.column("item_at").to_numpy(), return_index=True)
        cells = {"ats": ats.astype(np.int64), "item_starts": starts.astype(np.int64), "item_tids": own.column("tid").to_numpy().astype(np.int32), "weights": own.column("weight").to_numpy().astype(np.int64)}
        return pa.table({"block": pa.array([own.column("block")[0].as_py()], pa.int64()), **{k: pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for k, c in cells.items()}})

    blocked = items.select("item_at", "tid", "weight", F.pmod(F.xxhash64("item_at"), F.lit(-(-n_items // ITEMS))).alias("block"))
    return staged(blocked.groupBy("block").applyInArrow(run, "block long, ats binary, item_starts binary, item_tids binary, weights binary"), "lexical-items")


def beside(shards: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """shards, which name a block of items each, beside that block; a block goes to groups places, so that no key is hot."""
    spread = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups))).join(spread, ["block", "group"]).drop("group")


def unpacked(row: dict, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(row[name].as_py(), kind) for name, kind in kinds.items()]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}


def bounds(pairs: DataFrame) -> DataFrame:
    """shard, block, item_at, bound: the most that a document of the shard can score for an item, where it is above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            names, tops = unpacked(row, tids=np.int32, tops=np.int32)
            ats, starts, tids, weights = unpacked(row, ats=np.int64, item_starts=np.int64, item_tids=np.int32, weights=np.int64)
            at = np.minimum(np.searchsorted(names, tids), len(names) - 1)
            most = np.add.reduceat(np.where(names[at] == tids, tops[at].astype(np.int64) * weights, 0), starts)
            some = np.flatnonzero(most > 0)
            same = lambda name: pa.array(np.full(len(some), row[name].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([same("shard"), same("block"), pa.array(ats[some], pa.int64()), pa.array(most[some], pa.int64())], names=["shard", "block", "item_at", "bound"])

    return pairs.mapInArrow(run, "shard long, block long, item_at long, bound long")


def scored(pairs: DataFrame, k: int) -> DataFrame:
    """item_at, doc_id, score: each visiting item's k best documents of the shard that reach what the item has already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            docs, names, first, places, parts = unpacked(row, docs=np.int64, tids=np.int32, starts=np.int64, places=np.int32, parts=np.int32)
            ats, starts, tids, weights = unpacked(row, ats=np.int64, item_starts=np.int64, item_tids=np.int32, weights=np.int64)
            last, ends = np.append(first[1:], len(places)), np.append(starts[1:], len(tids))
            out = []
            for visit in row["visits"].as_py():
                i = int(np.searchsorted(ats, visit["item_at"]))
                total = np.zeros(len(docs), np.int64)
                own = slice(starts[i], ends[i])
                at = np.minimum(np.searchsorted(names, tids[own]), len(names) - 1)
                for t, weight in zip(at[names[at] == tids[own]].tolist(), weights[own][names[at] == tids[own]].tolist()):
                    total[places[first[t] : last[t]]] += weight * parts[first[t] : last[t]].astype(np.int64)
                some = np.flatnonzero(total >= max(visit["least"], 1))
                some = some[best(total[some], docs[some], k)]
                out.append((np.full(len(some), visit["item_at"]), docs[some], total[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for c in zip(*out)], names=["item_at", "doc_id", "score"])

    return pairs.mapInArrow(giving_back(run), "item_at long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item, ties by smaller doc_id (null last).

    docs has doc_id and text, items item_id and text; other columns don't matter. Texts are read whole; null
    and empty ones have no terms, so such items give no rows. Repeated rows, of documents or items, are rows of their own. Empty
    tables give no rows. Scores are as of 64-bit integers (see index and the weights below).

    The index holds the terms of all items. Documents are ordered by recursive graph bisection, fitted on about SAMPLE of them, and every
    document goes down its tree; each leaf is a cluster, cut into shards. An item visits shards by the falling most that a
    document there can score, in ROUNDS, and none whose bound is under its k-th score so far; at an equal bound it still goes, as a
    smaller doc_id could be there.
    """
    spark = docs.sparkSession
    result = "item_id long, rank int, doc_id long, score long"
    named = staged(items.select(F.col("item_id").cast("long"), terms_of(F.col("text").cast("string")).alias("terms")).withColumn("item_at", F.monotonically_increasing_id()), "lexical-asked")
    asked = named.select("item_at", F.explode("terms").alias("term")).groupBy("item_at", "term").agg(F.count(F.lit(1)).alias("times"))
    dictionary = staged(ordered_index(asked.select("term").distinct(), ["term"], "tid").select("term", F.col("tid").cast("int")), "lexical-dictionary")
    rows = with_terms(docs, dictionary)
    whole = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["docs"] or not dictionary.limit(1).count():
        return spark.createDataFrame([], result)
    n_docs = whole["docs"]
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)).cast("double"))).cast("long")
    weights = dictionary.join(document_counts(rows), "tid").select("term", "tid", weight.alias("w"))
    wanted = staged(asked.join(weights, "term").select("item_at", "tid", (F.col("times") * F.col("w")).alias("weight")).filter("weight > 0"), "lexical-wanted")
    n_items = wanted.select("item_at").distinct().count()
    if not n_items:
        return spark.createDataFrame([], result)
    shards = index(clustered(rows), n_docs, whole["terms"])
    blocks = item_blocks(wanted, n_items)
    groups = max(1, -(-shards.count() // 8))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n_items // ITEMS) - 1).cast("long")))
    most = staged(bounds(beside(shards.select("shard", "tids", "tops", every.alias("block")), blocks, groups)), "lexical-bounds")
    order = most.withColumn("at", F.row_number().over(Window.partitionBy("item_at").orderBy(F.col("bound").desc(), "shard")))
    found = least = None
    first = 0
    for last in ROUNDS:
        visits = order.filter((F.col("at") > first) & (F.col("at") <= last) if last else F.col("at") > first)
        visits = visits.withColumn("least", F.lit(0).cast("long")) if least is None else visits.join(least, "item_at", "left").withColumn("least", F.coalesce("least", F.lit(0))).filter("bound >= least")
        per = visits.groupBy("shard", "block").agg(F.collect_list(F.struct("item_at", "least")).alias("visits"))
        hits = scored(beside(shards.drop("tops").join(per, "shard"), blocks, groups), k)
        hits = hits if found is None else hits.unionByName(found.drop("rank"))
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_at").orderBy(F.col("score").desc(), "doc_id")))
        found = staged(ranked.filter(F.col("rank") <= k), "lexical-found")
        least = found.filter(F.col("rank") == k).select("item_at", F.col("score").alias("least"))
        first = last
    return found.join(named.select("item_at", "item_id"), "item_at").select("item_id", "rank", F.when(F.col("doc_id") != HIGH, F.col("doc_id")).alias("doc_id"), "score")

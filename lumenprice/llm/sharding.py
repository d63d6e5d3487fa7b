"""Sharding by vector bin packing (operator 9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, staged, word_count

#: Groups above this share of a shard, in any measure, are placed one by one before all others.
HEAVY_SHARE = 1 / 1024
#: Share of a shard's bytes that a piece of a split group has, about.
PIECE_SHARE = 1 / 16
#: Groups that one task places, about.
TASK_GROUPS = 20_000


def place(sizes: np.ndarray, room: np.ndarray, whole: bool = False) -> np.ndarray:
    """The shard of each item: of those with room for its bytes, the one with the highest dot product of item and room left.

    sizes (items, measures) and room (shards, measures) are shares of the whole, bytes first. Largest
    items first; ties go to the smaller shard. An item that fits nowhere goes where most bytes are
    left, so that bytes stay near equal; with whole it is left out (-1), to be split. room is changed to what is left.
    """
    out = np.empty(len(sizes), np.int32)
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        fits = room[:, 0] >= sizes[i, 0]
        if whole and not fits.any():
            out[i] = -1
            continue
        out[i] = shard = int(np.argmax(np.where(fits, room @ sizes[i], -np.inf) if fits.any() else room[:, 0]))
        room[shard] -= sizes[i]
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deals documents into shards of near equal bytes (and words and rows): doc_id, size, text_crc32, shard, slot.

    Needs doc_id and text; other columns don't matter. size is the text's UTF-8 bytes plus 1
    (null text: 1). Equal texts form a group and stay together; only a group that fits into no shard, as it has
    more bytes than a shard or comes behind larger ones that leave no such room, is split by a hash of row and doc_id. Groups above
    HEAVY_SHARE number at most 3 * shards / HEAVY_SHARE whatever the table's size, and are placed
    first, in one pass; the rest are placed by many tasks, each into its part of the room left. slot
    numbers a shard's rows from 0 without gaps. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = staged(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            word_count(text).alias("words"),
            F.xxhash64(text.isNull(), text, F.octet_length(text)).alias("gid"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shard-rows",
    )
    groups = staged(rows.groupBy("gid").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    measures = ["bytes", "words", "rows"]
    all_of = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures], F.count(F.lit(1)).alias("groups")).first()
    scale = np.array([max(1, all_of[m]) for m in measures], dtype=float)

    def above(share):
        return F.greatest(*[F.col(m) / F.lit(float(s)) for m, s in zip(measures, scale)]) > share / shards

    # Large groups go first, whole where a shard has room; at most 3 * shards / HEAVY_SHARE of them.
    heavy = groups.filter(above(HEAVY_SHARE)).select("gid", *measures).orderBy("gid").toPandas()
    room = np.full((shards, 3), 1.0 / shards)
    heavy["shard"] = place(heavy[measures].to_numpy(float) / scale, room, whole=True) if len(heavy) else pd.Series(dtype="int32")
    large = heavy[heavy["shard"] < 0]
    parts = np.minimum(large["rows"], np.ceil(large["bytes"] / scale[0] * shards / PIECE_SHARE)).astype(int) if len(large) else []
    split = spark.createDataFrame([(int(g), int(n)) for g, n in zip(large["gid"], parts)], "gid long, parts int")
    own_hash = F.xxhash64("doc_id", "at", F.lit(9))
    with_piece = rows.join(F.broadcast(split), "gid", "left").withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(own_hash, F.col("parts"))).cast("int")).drop("parts")
    pieces = with_piece.join(F.broadcast(split.select("gid")), "gid", "left_semi").groupBy("gid", "piece").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    cut = pieces.orderBy("gid", "piece").toPandas() if len(large) else pd.DataFrame({"gid": [], "piece": [], **{m: [] for m in measures}})
    cut["shard"] = place(cut[measures].to_numpy(float) / scale, room) if len(cut) else pd.Series(dtype="int32")
    kept = heavy[heavy["shard"] >= 0].assign(piece=0)
    heavy_at = spark.createDataFrame([(int(a), int(b), int(c)) for own in (kept, cut) for a, b, c in zip(own["gid"], own["piece"], own["shard"])], "gid long, piece int, shard int")

    n = max(1, -(-all_of["groups"] // TASK_GROUPS))

    def light(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gid", kind="stable")
        sizes = part[measures].to_numpy(float) / scale
        # its part of the room: as much as its groups need, in the proportion of what is left
        left = np.maximum(room, 0)
        own = left / np.maximum(left.sum(axis=0), 1e-300) * sizes.sum(axis=0)
        return pd.DataFrame({"gid": part["gid"], "piece": np.zeros(len(part), np.int32), "shard": place(sizes, own)})

    light_at = (
        groups.filter(~above(HEAVY_SHARE)).withColumn("task", F.pmod("gid", F.lit(n))).groupBy("task").applyInPandas(light, "gid long, piece int, shard int")
    )
    placed = with_piece.join(heavy_at.unionByName(light_at), ["gid", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    return positions(staged(placed, "shard-placed"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")

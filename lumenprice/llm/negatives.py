"""Hard negatives by bit-sliced integer products (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, partitions, staged
from .vectors import best, matrix, packed

#: Rows of a block of candidates (between these) and of a slab of anchors.
LEAST_BLOCK, BLOCK, SLAB = 1_024, 16_384, 1_024
#: Anchors whose scores with a block are worked on together, and the share of open pairs below which each anchor's open rows are taken alone.
TOGETHER, FEW = 64, 0.1
LOW, HIGH = -(1 << 62), 1 << 62
BLOCK_ROW = "block long, ids binary, ats binary, labels binary, planes binary"
ANCHOR_ROW = "slab long, ids binary, ats binary, labels binary, values binary, windows binary"


def bits_of(least: int, most: int) -> int:
    """Bits of two's complement that hold all numbers from least to most."""
    return max(max(most, 0).bit_length(), (-min(least, 0) - 1).bit_length() if least < 0 else 0) + 1


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """The bit-planes of integer rows, most significant (the sign's) first: bits x rows x packed bytes."""
    return np.stack([np.packbits((values >> k & 1).astype(np.uint8), axis=1) for k in range(bits - 1, -1, -1)])


def within(planes: np.ndarray, width: int, bits: int, anchors: np.ndarray, allowed: np.ndarray, windows: np.ndarray, ids: np.ndarray, k: int):
    """For each anchor and each of its windows the k best allowed rows whose score lies in the window: (anchor, window, row, score).

    Planes are added from the most significant. After each, the bits that are left bound a score
    from both sides; a row is dropped once its interval misses all windows, or once k rows surely inside a window are
    surely better, in each that it meets. anchors x rows in allowed say which pairs count.
    """
    exact = np.float64 if width * int(np.abs(anchors).max(initial=0)) << bits < 1 << 53 else np.int64
    q = anchors.astype(exact)
    rise, fall = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    least, most = windows[:, :, 0].min(axis=1), windows[:, :, 1].max(axis=1)
    total, open_, alone = np.zeros(allowed.shape, exact), allowed & (least <= most)[:, None], bits
    for at in range(bits):
        plane = np.unpackbits(planes[at], axis=1, count=width).astype(exact)
        left = bits - 1 - at
        total += (q @ plane.T) * (-(1 << left) if at == 0 else 1 << left)
        rest = (1 << left) - 1
        open_ &= (total + (rest * rise)[:, None] >= least[:, None]) & (total + (rest * fall)[:, None] <= most[:, None])
        if windows.shape[1] == 1 and at and len(ids) > k:
            low = np.where(open_ & (total + (rest * fall)[:, None] >= least[:, None]), total + (rest * fall)[:, None], LOW)
            open_ &= total + (rest * rise)[:, None] >= np.partition(low, -k, axis=1)[:, -k, None]
        if left and open_.mean() <= FEW:
            alone = at + 1
            break
    for i in range(len(anchors)):
        rows = np.flatnonzero(open_[i])
        scores = total[i, rows].astype(np.int64)
        for at in range(alone, bits + 1):
            rest = (1 << (bits - at)) - 1
            low, high = scores + rest * int(fall[i]), scores + rest * int(rise[i])
            keep = np.zeros(len(rows), bool)
            for a, b in windows[i]:
                meets = (high >= a) & (low <= b)
                inside = low[(low >= a) & (high <= b)]
                if len(inside) >= k:
                    meets &= high >= np.partition(inside, len(inside) - k)[len(inside) - k]
                keep |= meets
            rows, scores = rows[keep], scores[keep]
            if at < bits:
                plane = np.unpackbits(planes[at][rows], axis=1, count=width).astype(np.int64)
                scores = scores + (plane @ anchors[i] << (bits - 1 - at))
        for j, (a, b) in enumerate(windows[i]):
            some = np.flatnonzero((scores >= a) & (scores <= b))
            some = some[best(scores[some], ids[rows[some]], k)]
            for row, score in zip(rows[some].tolist(), scores[some].tolist()):
                yield i, j, row, score


def unpacked(column, kind=np.int64) -> np.ndarray:
    return np.frombuffer(column.as_py(), kind)


def compared(pairs: DataFrame, width: int, bits: int, k: int, same: bool) -> DataFrame:
    """anchor_at, anchor_id, positive (place of the window), at, vec_id, score from blocks that each stand beside a slab of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                ids, ats, labels = (unpacked(row[c]) for c in ("ids", "ats", "labels"))
                planes = unpacked(row["planes"], np.uint8).reshape(bits, len(ids), -1)
                a_ids, a_ats, a_labels = (unpacked(row[f"a_{c}"]) for c in ("ids", "ats", "labels"))
                values = unpacked(row["values"]).reshape(len(a_ids), width)
                windows = unpacked(row["windows"]).reshape(len(a_ids), -1, 2)
                out: list[tuple] = []
                # anchors of one label side by side: for positives they share their rows
                order = np.argsort(a_labels, kind="stable")
                cuts = np.flatnonzero(np.diff(a_labels[order])) + 1 if same else []
                for part in np.split(order, cuts):
                    of = np.flatnonzero(labels == a_labels[part[0]]) if same else np.arange(len(ids))
                    met = planes[:, of] if same else planes
                    for i in range(0, len(part), TOGETHER):
                        own = part[i : i + TOGETHER]
                        allowed = (a_ats[own][:, None] != ats[of][None, :]) if same else (a_labels[own][:, None] != labels[of][None, :])
                        for x, y, c, score in within(met, width, bits, values[own], allowed, windows[own], ids[of], k):
                            out.append((a_ats[own[x]], a_ids[own[x]], y, ats[of[c]], ids[of[c]], score))
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=["anchor_at", "anchor_id", "positive", "at", "vec_id", "score"])

    return pairs.mapInArrow(giving_back(run), "anchor_at long, anchor_id long, positive long, at long, vec_id long, score long")


def tiles(blocks: DataFrame, slabs: DataFrame, n_blocks: int, n_slabs: int) -> DataFrame:
    """Each block of candidates beside each slab of the stated anchors, every pair under a key of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("slab", every(n_slabs))
    names = ("ids", "ats", "labels")
    right = slabs.select("slab", *[F.col(c).alias(f"a_{c}") for c in names], "values", "windows").withColumn("block", every(n_blocks))
    return left.join(right.hint("shuffle_hash"), ["block", "slab"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's hardest rows of other labels.

    vectors has vec_id and embedding (and what is_anchor and label read); each component x becomes floor(scale * x). A score is the integer
    inner product with the anchor, higher first, ties by smaller vec_id (null last). An anchor's positives are its first rows of
    the same label; for each, negatives are the first rows of another label with share[0] * positive_score <= share[1] * score <= share[1] * positive_score.

    Rows with a null label, a null vector or a null or non-finite component take no part; repeated rows
    are rows of their own (one may be the other's positive); shorter vectors count as ending in zeros; an anchor without positives or
    negatives gives no rows, like an empty table; other columns don't matter. A score that could leave 64 bits is an error.

    Candidates are stored as blocks of bit-planes; anchors meet every block in slabs, first for positives, then for negatives.
    """
    spark = vectors.sparkSession

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.floor(scale * np.frombuffer(x)) for x in batch.column("v").to_pylist()]
            if any(len(x) and np.abs(x).max() >= 2.0**31 for x in v):
                raise ValueError("a component is too large for scores of 64 bits")
            columns = [pa.array([x.astype(np.int64).tobytes() for x in v], pa.binary()), pa.array([int(x.min(initial=0)) for x in v], pa.int64()), pa.array([int(x.max(initial=0)) for x in v], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], names=["vec_id", "v", "least", "most"])

    # the label and the anchor's mark travel as the id through packed(), which knows one id: rows are numbered first
    named = staged(
        vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(HIGH)).alias("own_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col("embedding").alias("v"))
        .filter("label is not null").withColumn("at", F.monotonically_increasing_id()), "negatives-named",
    )
    values = packed(named, "at", "v").mapInArrow(whole, "vec_id long, v binary, least long, most long").withColumnRenamed("vec_id", "at")
    rows = staged(named.drop("v").join(values, "at"), "negatives-rows")
    shape = rows.agg(F.max(F.octet_length("v")).alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shape["bytes"] or not shape["anchors"]:
        return spark.createDataFrame([], result)
    width, bits = shape["bytes"] // 8, bits_of(shape["least"], shape["most"])
    if width << 2 * bits >= 1 << 61:
        raise ValueError("scores could leave 64 bits")
    size = int(np.clip(shape["n"] // (4 * partitions(spark)), LEAST_BLOCK, BLOCK))

    n_blocks, n_slabs = -(-shape["n"] // size), -(-shape["anchors"] // SLAB)

    def to_block(table: pa.Table) -> pa.Table:
        v = matrix(table.column("v").to_pylist(), width, np.int64)
        cells = [np.ascontiguousarray(table.column(c).to_numpy().astype(np.int64)).tobytes() for c in ("own_id", "at", "label")]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "ats", "labels"), cells)}, "planes": pa.array([slices(v, bits).tobytes()], pa.binary())})

    def to_slab(table: pa.Table) -> pa.Table:
        v = matrix(table.column("v").to_pylist(), width, np.int64)
        cells = [np.ascontiguousarray(table.column(c).to_numpy().astype(np.int64)).tobytes() for c in ("own_id", "at", "label")]
        windows = np.full((len(v), positives, 2), (HIGH, LOW), np.int64)
        for i, scores in enumerate(table.column("scores").to_pylist()):
            for j, s in enumerate(scores):
                windows[i, j] = (LOW, HIGH) if s is None else (-(-share[0] * s // share[1]), s)
        if table.column("scores")[0].as_py() == [None]:
            windows = windows[:, :1]
        return pa.table({"slab": pa.array([table.column("slab")[0].as_py()], pa.int64()), **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "ats", "labels"), cells)}, "values": pa.array([v.tobytes()], pa.binary()), "windows": pa.array([windows.tobytes()], pa.binary())})

    dealt = lambda own, name, n: own.withColumn(name, F.pmod(F.xxhash64("at"), F.lit(n)))
    blocks = staged(dealt(rows, "block", n_blocks).groupBy("block").applyInArrow(to_block, BLOCK_ROW), "negatives-blocks")
    anchors = dealt(rows.filter("is_anchor"), "slab", n_slabs)

    def slabs(scored: DataFrame) -> DataFrame:
        return staged(scored.groupBy("slab").applyInArrow(to_slab, ANCHOR_ROW), "negatives-slabs")

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "at")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    all_scores = slabs(anchors.withColumn("scores", F.array(F.lit(None).cast("long"))))
    known = staged(first(compared(tiles(blocks, all_scores, n_blocks, n_slabs), width, bits, positives, True), ["anchor_at"], positives).select("anchor_at", (F.col("rank") - 1).cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    scores = known.groupBy("anchor_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    if not known.limit(1).count():
        return spark.createDataFrame([], result)
    banded = slabs(anchors.join(scores, anchors["at"] == scores["anchor_at"]).drop("anchor_at"))
    found = first(compared(tiles(blocks, banded, n_blocks, n_slabs), width, bits, negatives, False), ["anchor_at", "positive"], negatives)
    back = lambda c: F.when(F.col(c) != HIGH, F.col(c))
    return (
        found.join(known, ["anchor_at", "positive"])
        .select(back("anchor_id").alias("anchor_id"), back("positive_id").alias("positive_id"), "rank", back("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )

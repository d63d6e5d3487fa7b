"""SimHash near-duplicates by the generalised pigeonhole principle (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, partitions, staged
from .components import components
from .rows import flagged, numbered
from .substring_exact import runs_at_keys

#: A-Z to a-z, and each white space to a blank.
FOLD = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints that the costs of partitions and thresholds are estimated on; results don't depend on them.
ESTIMATE_ROWS = 4096
#: Members of one probe key that one task compares; more are dealt out as pairs of blocks.
BLOCK = 20_000
#: 64-bit parts of a wide SimHash, and their multipliers.
LANES = 4
LANE = np.random.default_rng(7).integers(1, 1 << 62, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits in which candidates for a similarity of 0.8 differ at most, of the first 64 and of all; 10 and 39 are expected (12 and 49 in the shortest texts).
MOST_LANE, MOST_WIDE = 22, 76
#: Bits within which texts of one batch are taken for one when candidates are sought: a text within 50 bits of one of them is within MOST_WIDE of the other.
TIGHT = 26
#: Bits of 64 within which the pigeonhole finds every pair for a similarity of 0.8; draws look for those beyond.
NEAR = 7
#: Chance that no draw of bits agrees for two texts just at the similarity.
MISSED = 0.02
#: Rows of a candidate group's block.
GROUP = 500
ENTRY = np.dtype([("key", "<u8"), ("row", "<i8"), ("size", "<i8"), ("fp", "<u8", (LANES,))])


def fingerprint(text: str, width: int, xxh64) -> int:
    """The 64-bit SimHash of the shingles of width words, each counted as often as it occurs."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[: 1 - width].tolist()
        hashes = [xxh64(joined[s:e], 42) for s, e in zip(start, end[width - 1 :].tolist())]
    n = len(hashes)
    bits = np.unpackbits(np.fromiter(hashes, "<u8", n).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; null and blank texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = np.fromiter((fingerprint(t or "", width, xxh64_intdigest) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), "doc_id long, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in parts of near equal width, correlated bits together (greedy)."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    free, out = set(range(64)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        own = [max(free, key=lambda b: (sum(corr[b, o] for o in free if o != b), -b))]
        free -= set(own)
        while len(own) < width:
            b = max(free, key=lambda b: (sum(corr[b, o] for o in own), -b))
            own.append(b)
            free.discard(b)
        out.append(sorted(own))
    return out


def thresholds(sample: np.ndarray, groups: list[list[int]], most: int, rows: int) -> tuple[float, list[int]]:
    """The cheapest thresholds t with sum(t) = most - parts + 1, and their cost in candidates and probes a row.

    If two fingerprints differ in at most most bits, they differ in at most t[i] bits of some part
    i. Candidate counts of each part and threshold come from pairs of the sample; dynamic
    programming over parts deals out the sum. -1 leaves a part out.
    """
    seen = len(sample)
    cost = []
    for own in groups:
        mask = np.uint64(sum(1 << b for b in own))
        part = sample & mask
        near = np.zeros(most + 2)
        for i in range(0, seen, 512):
            d = np.bitwise_count(part[i : i + 512, None] ^ part[None, :])
            near += np.bincount(np.minimum(d, most + 1).ravel(), minlength=most + 2)[: most + 2]
        near[0] -= seen  # itself
        share = np.cumsum(near[: most + 1]) / max(1, seen * (seen - 1))
        # at least one pair in 2^width must be expected where the sample shows none
        floor = [sum(math.comb(len(own), j) for j in range(t + 1)) / 2.0 ** len(own) for t in range(most + 1)]
        probes = [sum(math.comb(len(own), j) for j in range(t + 1)) for t in range(most + 1)]
        cost.append([0.0] + [0.02 * rows * max(s, f) + 4.0 * p for s, f, p in zip(share, floor, probes)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (price, chosen) in best.items():
            for t in range(-1, most + 1):
                new = (price + c[t + 1], [*chosen, t])
                if total + t not in after or new < after[total + t]:
                    after[total + t] = new
        best = after
    return best[most - len(groups) + 1]


def probe_plan(sample: np.ndarray, most: int, rows: int) -> list[tuple[int, list[int]]]:
    """(mask, differences) of each part that is probed: keys are fp & mask ^ difference."""
    choices = []
    for parts in range(2, most + 2):
        groups = bit_groups(sample, parts)
        choices.append((*thresholds(sample, groups, most, rows), groups))
    _, chosen, groups = min(choices, key=lambda c: c[0])
    out = []
    for t, own in zip(chosen, groups):
        if t >= 0:
            out.append((sum(1 << b for b in own), [sum(1 << b for b in c) for j in range(t + 1) for c in combinations(own, j)]))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep the components of the given ones: each node to its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links_of(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a forest) among rows sorted by key: probing rows against the rows that have the key's bits."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    found_a, found_b = [], []

    def keep(a, b):
        # a pair is reached from both sides unless the key is the probe's own
        if len(a):
            a, b = forest(a, b)
            found_a.append(a)
            found_b.append(b)

    small = np.repeat(sizes <= 64, sizes)
    k, f, p = key[small], fp[small], probe[small]
    for d in range(1, int(min(64, sizes.max(initial=0)))):
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= most) & (f[d:] != f[:-d]) & ~(p[d:] & p[:-d])
        keep(f[d:][hit], f[:-d][hit])
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        own, is_probe = fp[s : s + n], probe[s : s + n]
        members = own[~is_probe]
        for i in range(0, n, 1024):
            row = own[i : i + 1024]
            for j in range(0, len(members), 8192):
                x, y = np.nonzero(np.bitwise_count(row[:, None] ^ members[None, j : j + 8192]) <= most)
                a, b = row[x], members[j : j + 8192][y]
                keep(a[a != b], b[a != b])
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Edges a, b that join every two fingerprints (column fp, each once) with most differing bits or fewer.

    Not all pairs: of the links that a task finds, those that keep its components. Keys with more
    than BLOCK rows are dealt out as pairs of blocks to several tasks, so that none is left out.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(ESTIMATE_ROWS).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    if rows < 2:
        return spark.createDataFrame([], "a long, b long")
    plan = probe_plan(sample, most, rows)
    masks = [np.uint64(m) for m, _ in plan]
    differences = [np.array(d, np.uint64) for _, d in plan]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (mask, diff) in enumerate(zip(masks, differences)):
                for j in range(0, len(fp), max(1, 500_000 // len(diff))):
                    own = fp[j : j + max(1, 500_000 // len(diff))]
                    key = ((own & mask)[:, None] ^ diff[None, :]).ravel()
                    columns = [np.full(len(key), i, np.int32), key.view(np.int64), np.repeat(own, len(diff)).view(np.int64), np.tile(diff != 0, len(own))]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["part", "key", "fp", "probe"])

    probes = distinct.select("fp").mapInArrow(giving_back(keys), "part int, key long, fp long, probe boolean")
    # keys that many share: each row of block i goes to all pairs of blocks that hold i
    large = probes.filter("not probe").groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    large = staged(large, "simhash-large")
    if large.limit(1).count():
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("_b")) * F.col("blocks") + F.greatest(o, F.col("_b")))
        probes = (
            probes.join(large, ["part", "key"], "left")
            .withColumn("_b", F.when(F.col("blocks").isNotNull(), block))
            .withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(pairs)))
            .select("part", "key", "pair", "fp", "probe")
        )
    else:
        probes = probes.select("part", "key", F.lit(-1).alias("pair"), "fp", "probe")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        made: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(key, fp, probe):
            if len(key) > 1:
                made.append(links_of(key, fp.view(np.uint64), probe, most))

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "fp", "probe")]
            held = [np.concatenate([h, n]) for h, n in zip(held, new)]
            if len(held[0]) >= 100_000 and held[0][0] != held[0][-1]:
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                flush(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        flush(*held)
        if made:
            a, b = (np.concatenate(x) for x in zip(*made))
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    n = max(partitions(spark), 1)
    grouped = probes.withColumn("gid", F.xxhash64("part", "key", "pair")).select("gid", "fp", "probe").repartition(n, "gid").sortWithinPartitions("gid", "probe", "fp")
    return grouped.mapInArrow(giving_back(find), "a long, b long")


def without_near_duplicates(docs: DataFrame, width: int = 5, most: int = 7) -> DataFrame:
    """The rows of docs (doc_id, text and others), one of each group of near duplicates: the smallest doc_id.

    Of repeated doc_ids the one that comes first by text is kept, and of repeated rows one. Null and blank
    texts are copies of each other. All columns are carried along, whatever their names.
    """
    rows = numbered(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")), "all")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), width, most)
    lost = staged(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("row")), "simhash-lost")
    maybe = flagged(rows, lost)
    kept = maybe.filter("_there").join(lost, "row", "left_anti").select("all.*").unionByName(maybe.filter("not _there").select("all.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def shingle_hashes(text: str, width: int, xxh64) -> np.ndarray:
    """The distinct shingles of width words (a shorter text is one), as sorted hashes; none of a blank text."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    joined = b" ".join(words)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: 1 - width].tolist()
    return np.unique(np.fromiter((xxh64(joined[s:e], 42) for s, e in zip(start, end[width - 1 :].tolist())), np.uint64, len(start)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of LANES times 64 bits of a text's distinct shingles."""
    ones = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None] * LANE
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def shingled(rows: DataFrame, width: int) -> DataFrame:
    """row, size, fp (the wide SimHash), lane (its first 64 bits) and same (a hash of all shingles) of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for batch in batches:
            sets = [shingle_hashes(t or "", width, xxh64_intdigest) for t in batch.column(1).to_pylist()]
            prints = [wide_fingerprint(s) for s in sets]
            lanes = np.frombuffer(b"".join(prints), "<i8")[::LANES]
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(lanes), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "fp", "lane", "same"])

    return rows.select("row", "text").mapInArrow(giving_back(run), "row long, size long, fp binary, lane long, same binary")


def draws(rows: int, similar: float) -> list[np.ndarray]:
    """Bits of wide SimHashes, drawn so often that texts of the similarity agree in one draw but for a chance of MISSED.

    Parts with a threshold of zero each: at a similarity of 0.8, 15 % of the bits differ, and disjoint parts
    with the thresholds that the pigeonhole needs would meet every tenth pair. A draw has log2(rows) bits, so that few
    texts agree by chance; draws grow with rows^0.24.
    """
    alike = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    width = min(48, max(8, math.ceil(math.log2(max(2, rows)))))
    random = np.random.default_rng(5)
    return [np.sort(random.choice(64 * LANES, width, replace=False)) for _ in range(math.ceil(math.log(MISSED) / math.log(1 - alike**width)))]


def near(e: np.ndarray, x, y, most: int, similar: float) -> np.ndarray:
    """Which entries of e at x and y have most differing bits or fewer and sizes that allow the similarity."""
    ok = np.bitwise_count(e["fp"][x, 0] ^ e["fp"][y, 0]) <= MOST_LANE
    ok &= np.minimum(e["size"][x], e["size"][y]) >= similar * np.maximum(e["size"][x], e["size"][y])
    if np.ndim(x):
        x = x[ok]
    ok[ok] = np.bitwise_count(e["fp"][x] ^ e["fp"][y[ok]]).sum(axis=1, dtype=np.int64) <= most
    return ok


def near_entries(e: np.ndarray, most: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of entries, in the order of their keys, that join near ones of equal keys: a forest.

    In large groups a search goes from each entry to those not yet found, so a group of near copies is passed over about once.
    """
    new = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(e)))
    left = np.repeat(start + size, size) - np.arange(len(e))  # entries of the group from here on
    at = np.flatnonzero(np.repeat(size <= 32, size))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for d in range(1, 32):
        at = at[left[at] > d]
        ok = near(e, at, at + d, most, similar)
        out.append((e["row"][at[ok]], e["row"][at[ok] + d]))
    for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist()):
        unseen = np.arange(s, s + n)
        while len(unseen):
            root, unseen = unseen[0], unseen[1:]
            open_ = [root]
            while open_ and len(unseen):
                ok = near(e, open_.pop(), unseen, most, similar)
                found, unseen = unseen[ok], unseen[~ok]
                open_ += found.tolist()
                out.append((e["row"][found], np.full(len(found), e["row"][root])))
    return forest(*(np.concatenate(c) for c in zip(*out)))


def one_of_tight(e: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of large groups of entries in the order of their keys, one of those within TIGHT bits; and links to it."""
    start = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
    size = np.diff(np.append(start, len(e)))
    keep, out = np.ones(len(e), bool), []
    for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist()):
        unseen = np.arange(s, s + n)
        while len(unseen):
            root, unseen = unseen[0], unseen[1:]
            ok = np.bitwise_count(e["fp"][unseen] ^ e["fp"][root]).sum(axis=1, dtype=np.int64) <= TIGHT
            found, unseen = unseen[ok], unseen[~ok]
            keep[found] = False
            out.append((e["row"][found], np.full(len(found), e["row"][root])))
    return e[keep], out


def candidate_links(texts: DataFrame, similar: float) -> DataFrame:
    """Edges a, b that keep the components of pairs that agree in a draw of bits, with at most MOST_WIDE differing bits and sizes that allow the similarity."""
    spark = texts.sparkSession
    chosen = draws(texts.count(), similar)
    bits = max(4, (2 * partitions(spark) - 1).bit_length())
    edges_of = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 5_000) for b in batches for i in range(0, b.num_rows, 5_000)):
            row, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "size"))
            prints = b"".join(batch.column("fp").to_pylist())
            fp = np.frombuffer(prints, "<u8").reshape(len(row), LANES)
            ones = np.unpackbits(np.frombuffer(prints, np.uint8).reshape(len(row), -1), axis=1, bitorder="little")
            entries, edges = [], []
            for k, own in enumerate(chosen):
                e = np.empty(len(row), ENTRY)
                value = (ones[:, own].astype(np.uint64) << np.arange(len(own), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                value = (value + np.uint64(k << 48)) * np.uint64(0x9E3779B97F4A7C15)
                e["key"], e["row"], e["size"], e["fp"] = (value ^ value >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93), row, size, fp
                e, links = one_of_tight(e[np.lexsort((row, e["key"]))])
                entries.append(e)
                edges += links
            e = np.concatenate(entries)
            e = e[np.argsort(e["key"], kind="stable")]
            ends = [*np.searchsorted(e["key"], edges_of).tolist(), len(e)]
            made = [(i, False, e[s:t].tobytes()) for i, (s, t) in enumerate(zip([0, *ends], ends)) if t > s]
            if edges:
                a, b = forest(*(np.concatenate(c) for c in zip(*edges)))
                made.append((int(a[0]) & (1 << bits) - 1, True, np.stack([a, b]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "known", "packed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_at_keys(batches, "part", 1):
            out, entries = [], []
            for known, data in zip(batch.column("known").to_pylist(), batch.column("packed").to_pylist()):
                if known:
                    out.append(tuple(np.frombuffer(data, np.int64).reshape(2, -1)))
                else:
                    entries.append(np.frombuffer(data, ENTRY))
            if entries:
                e = np.concatenate(entries)
                out.append(near_entries(e[np.lexsort((e["row"], e["key"]))], MOST_WIDE, similar))
            a, b = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # a row for each part of a batch
    sent = texts.select("row", "size", "fp").mapInArrow(giving_back(run), "part int, known boolean, packed binary")
    sent = sent.repartition(partitions(spark), "part").sortWithinPartitions("part")
    return sent.mapInArrow(giving_back(find), "a long, b long").distinct()


def pigeonhole_links(texts: DataFrame, most: int) -> DataFrame:
    """Edges a, b that join every two of texts (row, lane) whose SimHashes differ in at most most of 64 bits, found as operator 7 finds them."""
    own = staged(texts.groupBy(F.col("lane").alias("fp")).agg(F.min("row").alias("first")), "simhash-lanes")
    near = links(own, most)
    near = near.join(own.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    equal = texts.join(own, F.col("lane") == F.col("fp")).filter("row <> first")
    return near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(equal.select(F.col("row").alias("a"), F.col("first").alias("b")))


def verified_links(rows: DataFrame, candidates: DataFrame, width: int, similar: float) -> DataFrame:
    """Edges a, b of rows (row, text) whose shingles' Jaccard similarity is at least similar, that keep the components of all such pairs.

    candidates: edges whose components hold all pairs in question. A component's rows are dealt as pairs of
    blocks of GROUP rows, so that a large one is shared out. In a task, pairs that are joined already
    aren't compared.
    """
    spark = rows.sparkSession
    roots = staged(components(candidates), "simhash-roots")
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    many = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / GROUP).cast("int"))
    placed = nodes.join(many, "root").withColumn("_b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("_b")) * F.col("blocks") + F.greatest(o, F.col("_b")))
    members = placed.select(F.col("node").alias("row"), "root", F.explode(pair).alias("pair"))
    there = flagged(rows.select("row", "text"), nodes.select(F.col("node").alias("row"))).filter("_there")
    dealt = there.join(members, "row").withColumn("gid", F.xxhash64("root", "pair")).select("gid", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in runs_at_keys(batches, "gid", 1):
            gid, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "row"))
            starts = np.append(np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])), len(gid)).tolist()
            out = []
            for s, e in zip(starts, starts[1:]):
                sets = [shingle_hashes(t.as_py() or "", width, xxh64_intdigest) for t in batch.column("text").slice(s, e - s)]
                out += [(int(row[s + a]), int(row[s + b])) for a, b in jaccard_links(sets, similar)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sent = dealt.repartition(max(partitions(spark), 1), "gid").sortWithinPartitions("gid", "row")
    return sent.mapInArrow(giving_back(run), "a long, b long")


def jaccard_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Pairs of sorted sets with a Jaccard similarity of similar or more, as far as they join components anew."""
    label = np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    out = []
    for i in range(1, len(sets)):
        left = np.flatnonzero((np.minimum(size[:i], size[i]) >= similar * np.maximum(size[:i], size[i])) & (label[:i] != label[i]))
        while len(left):
            j = int(left[0])
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similar * (size[i] + size[j] - both):
                out.append((j, i))
                label[label == label[i]] = label[j]
            left = left[1:]
            left = left[label[left] != label[i]]
    return out


def without_similar(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of docs (doc_id, text and others), one of each group of near duplicates: the smallest doc_id.

    Near duplicates are those that pairs with a Jaccard similarity of their distinct shingles of similar or more link.
    The pigeonhole finds all pairs within NEAR bits of 64, draws of wide SimHashes look for those beyond, and the shingles decide. Of repeated doc_ids the one that comes
    first by text is kept, and of repeated rows one. Null and blank texts are copies of each other. All
    columns are carried along, whatever their names.
    """
    rows = numbered(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")), "all")
    prints = staged(shingled(rows, width), "simhash-rows")
    texts = staged(prints.groupBy("same").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("lane").alias("lane")), "simhash-distinct")
    copies = prints.select("row", "same").join(texts.select("same", F.col("row").alias("first")), "same").filter("row != first").select("row")
    candidates = candidate_links(texts, similar).unionByName(pigeonhole_links(texts.select("row", "lane"), NEAR))
    found = staged(verified_links(rows, staged(candidates, "simhash-candidates"), width, similar), "simhash-links")
    lost = staged(copies.unionByName(components(found).select(F.col("node").alias("row"))), "simhash-lost")
    maybe = flagged(rows, lost)
    kept = maybe.filter("_there").join(lost, "row", "left_anti").select("all.*").unionByName(maybe.filter("not _there").select("all.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that is reachable over fingerprints of most differing bits
    or fewer. Null and blank texts have fingerprint zero and are linked like any other; repeated
    rows are kept; a null doc_id is never a component_id unless all of a component are null; an
    empty table gives no rows; other columns don't matter.
    """
    rows = staged(fingerprints(docs, width), "simhash-rows")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

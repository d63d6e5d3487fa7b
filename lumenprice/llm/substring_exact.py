"""Removal of exact repeats of long byte strings, by suffix arrays (operator 1).

A string of `most` bytes lies in the segment of the smallest hash among its KMER-byte substrings (its
anchor). Equal strings have the same anchor, so segments meet by anchor. Equal segments are merged,
first within a task and then by anchor; of what is left, only segments that share an anchor with
a different one are fetched from the texts and go through the suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .rows import in_map, numbered
from .suffix import equal_to_next, suffix_array

KMER = 32
#: Positions of a text that are hashed at a time; segments of a task that are merged at a time.
STRETCH, MERGE = 1 << 20, 1_000_000
#: Segments of one key that one suffix array takes; keys with more are refined.
GROUP = 20_000
#: Bytes of one suffix array (more only where a single key has more).
ARRAY_BYTES = 2_000_000

RANDOM = np.random.default_rng(1)
OF_BYTE = RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.full(STRETCH + 1, base, np.uint64)
            out[0] = 1
            POWERS.append(np.cumprod(out, dtype=np.uint64))
    return POWERS[0], POWERS[1]


def segments(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, segment's hash, start, length, anchor's place in it) of all segments of a text."""
    out = []
    w = most - KMER + 1
    up, down = powers()
    step = STRETCH - most + 1
    for first in range(0, max(0, len(text) - most + 1), step):
        part = text[first : first + STRETCH]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(OF_BYTE[part] * down[:n], out=sums[1:])
        h = (sums[KMER:] - sums[: n - KMER + 1]) * up[: n - KMER + 1]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        low = h & ~np.uint64(STRETCH - 1) | np.arange(len(h), dtype=np.uint64)  # ties: the first
        span = 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        at = (low & np.uint64(STRETCH - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        length = np.diff(np.append(start, len(at))) + most - 1
        own = (sums[start + length] - sums[start]) * up[start] + length.astype(np.uint64) * OF_BYTE[0]
        own = (own ^ own >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        out.append((h[at[start]], own, start + first, length, at[start] - start))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def batch_of(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


OCCURRENCE = ["anchor", "segment", "row", "span"]
PACK = 16  # span: start << 16 | length << 8 | anchor's place


def joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping stretches of the same row as one; ends rise with the starts."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])]) if len(row) else np.empty(0, bool)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1) if len(row) else np.empty(0, np.int64)
    return row[new], lo[new], hi[last]


def occurrences(rows: DataFrame, most: int) -> DataFrame:
    """anchor, segment, row, span of the segments of all texts (row, text): of equal ones within a task, the first.

    What the others cover is repeated; it comes as rows with span = -1 - lo, segment = hi and any anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged():
            anchor, segment, row, span = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((span, row, segment, anchor))
            anchor, segment, row, span = anchor[order], segment[order], row[order], span[order]
            again = np.zeros(len(row), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1])
            start = span[again] >> PACK
            r, lo, hi = joined(row[again], start, start + (span[again] >> 8 & 255))
            spread = (r.view(np.uint64) * OF_BYTE[1] + lo.astype(np.uint64)) * OF_BYTE[2]
            columns = [(anchor[~again], spread), (segment[~again].view(np.int64), hi), (row[~again], r), (span[~again], -1 - lo)]
            columns = [np.concatenate([x.view(np.int64), y.view(np.int64)]) for x, y in columns]
            for i in range(0, len(columns[0]), 100_000):
                yield batch_of(OCCURRENCE, *(c[i : i + 100_000] for c in columns))

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.empty(0, np.uint8)
                if len(data) >= most:
                    anchor, segment, start, length, place = segments(data, most)
                    held.append((anchor, segment, np.full(len(start), row, np.int64), start << PACK | length << 8 | place))
                    size += len(start)
                    if size >= MERGE:
                        yield from merged()
                        held.clear()
                        size = 0
        if held:
            yield from merged()

    return rows.select("row", "text").mapInArrow(run, "anchor long, segment long, row long, span long")


def runs_at_keys(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.RecordBatch]:
    """The batches of a partition that is sorted by key, joined and cut so that no key is cut, with least rows or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        keys = batch.column(key)
        if n >= least:
            values = keys.to_numpy(zero_copy_only=False)
            other = np.flatnonzero(values != values[-1])
            if len(other):
                cut = int(other[-1]) + 1
                held[-1] = batch.slice(0, cut)
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [batch.slice(cut)], batch.num_rows - cut
            elif len(held) > 1 and held[-2].column(key)[-1].as_py() != values[0]:
                yield pa.Table.from_batches(held[:-1]).combine_chunks().to_batches()[0]
                held, n = held[-1:], batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def met(found: DataFrame) -> DataFrame:
    """fetch, row, span, hi: of segments whose anchor has others, the first occurrence (fetch 1);
    and what is repeated, as bytes span to hi (fetch 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_at_keys(batches, "anchor", 100_000):
            anchor, segment, row, span = (batch.column(c).to_numpy(zero_copy_only=False) for c in OCCURRENCE)
            known = span < 0
            yield batch_of(["fetch", "row", "span", "hi"], np.zeros(int(known.sum())), row[known], -1 - span[known], segment[known])
            anchor, segment, row, span = anchor[~known], segment[~known], row[~known], span[~known]
            if len(row):
                new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                new = new_anchor | np.concatenate([[True], segment[1:] != segment[:-1]])
                group = np.cumsum(new_anchor) - 1
                first = new & (np.bincount(group[new])[group] > 1)
                yield batch_of(["fetch", "row", "span", "hi"], np.ones(int(first.sum())), row[first], span[first], row[first])
                start = span[~new] >> PACK
                r, lo, hi = joined(row[~new], start, start + (span[~new] >> 8 & 255))
                yield batch_of(["fetch", "row", "span", "hi"], np.zeros(len(r)), r, lo, hi)

    n = partitions(found.sparkSession)
    dealt = found.repartition(n, "anchor").sortWithinPartitions(*OCCURRENCE)
    return dealt.mapInArrow(run, "fetch long, row long, span long, hi long")


PART = "key long, row long, start long, core long, core_length long, data binary"


def refined(key: int, row: int, start: int, core: int, size: int, data: bytes, most: int, hash_of) -> Iterator[tuple]:
    """Splits the strings of a part by which side of its core they have more of.

    All strings of most bytes in data hold the core, the bytes core to core + size. Those with
    half of the rest or more on the left share a longer core to the left, the others to the right; the hash of it
    is the new key. Equal strings get equal keys.
    """
    rest = most - size
    if rest <= 0:
        yield key, row, start, core, size, data
        return
    half = -(-rest // 2)
    strings = len(data) - most + 1
    left = max(0, min(strings, core - half + 1))  # strings 0..left-1 begin half or more before the core
    if left:
        own = data[: left + most - 1]
        yield hash_of(own[core - half : core + size]), row, start, core - half, size + half, own
    if left < strings:
        own, c = data[left:], core - left
        yield hash_of(own[c : c + size + rest - half + 1]), row, start + left, c, min(most, size + rest - half + 1), own


def hash_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["key", "row", "start", "core", "core_length", "data"])


def covered_by_arrays(batch: pa.RecordBatch, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, from, to of the bytes of a batch of parts (whole keys) that an earlier equal string covers."""
    key, row, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row", "start"))
    column = batch.column("data")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(first) - 1
    several = np.bincount(group)[group] > 1  # a key's only part repeats nothing
    out = []
    at = np.flatnonzero(several)
    while len(at):
        total = np.cumsum(sizes[at])
        n = max(1, int(np.searchsorted(total, ARRAY_BYTES)))
        while n < len(at) and group[at[n]] == group[at[n - 1]]:
            n += 1
        own, at = at[:n], at[n:]
        text = np.frombuffer(b"".join(column[int(i)].as_py() for i in own), np.uint8)
        size = sizes[own]
        begin = np.cumsum(size) - size
        part = np.repeat(np.arange(len(own)), size)
        array = suffix_array(text, most)
        array = array[array - begin[part[array]] <= size[part[array]] - most]  # strings within one part
        same = equal_to_next(array, text, most)
        run = np.concatenate([[0], np.cumsum(~same)])
        where = start[own][part[array]] + array - begin[part[array]]
        order = np.lexsort((where, row[own][part[array]], run))
        again = np.zeros(len(order), bool)
        again[1:] = run[order[1:]] == run[order[:-1]]
        hit = order[again]
        r, s = row[own][part[array[hit]]], where[hit]
        by = np.lexsort((s, r))
        r, s = r[by], s[by]
        if len(r):
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)
            out.append((r[new], s[new], s[last] + most))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def repeats(rows: DataFrame, most: int) -> DataFrame:
    """row, lo, hi: bytes that a string of most bytes covers which also starts earlier. Stretches may overlap."""
    spark = rows.sparkSession
    by_anchor = staged(met(occurrences(rows, most)), "repeat-met")
    again = by_anchor.filter("fetch = 0").select("row", F.col("span").alias("lo"), "hi")
    wanted = by_anchor.filter("fetch = 1")
    there = in_map(spark, wanted)
    texts = rows.select("row", "text").filter(there(F.xxhash64("row")))
    lists = wanted.groupBy("row").agg(F.collect_list("span").alias("spans"))  # of one document each

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, spans in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                data = text.as_buffer().to_pybytes()
                for span in spans:
                    s, n, place = span >> PACK, span >> 8 & 255, span & 255
                    out += refined(0, row, s, place, KMER, data[s : s + n], most, hash_of)
                if len(out) > 20_000:
                    yield parts_batch(out)
                    out = []
            yield parts_batch(out)

    parts = staged(texts.join(lists, "row").select("row", "text", "spans").mapInArrow(fetch, PART), "repeat-parts")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parts_batch([p for r in zip(*(c.to_pylist() for c in batch.columns)) for p in refined(*r, most, hash_of)])

    done = None
    while True:  # a core grows by half of what lacks each time, up to the whole string
        large = staged(parts.filter(F.col("core_length") < most).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("key"), "repeat-large")
        if not large.limit(1).count():
            break
        rest = parts.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parts = staged(parts.join(large, "key", "left_semi").select("key", "row", "start", "core", "core_length", "data").mapInArrow(refine, PART), "repeat-parts")
    parts = parts if done is None else done.unionByName(parts)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_at_keys(batches, "key", 20_000):
            yield batch_of(["row", "lo", "hi"], *covered_by_arrays(batch, most))

    sorted_parts = parts.select("key", "row", "start", "data").repartition(partitions(spark), "key").sortWithinPartitions("key", "row", "start")
    return again.unionByName(sorted_parts.mapInArrow(sort, "row long, lo long, hi long"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes) of every row of docs (doc_id, text).

    Bytes that are covered by a string of most bytes (KMER < most < 200) that also starts earlier,
    in a smaller doc_id or earlier in the text, are removed. Texts are UTF-8, null ones empty;
    shorter ones lose nothing. Rows with the same doc_id come in the order of their texts, so
    that of repeated rows one is kept; null doc_ids come last. spans are the removed stretches as
    (lo, hi). An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    rows = numbered(docs)
    lost = staged(repeats(rows, most), "repeat-lost")
    there = in_map(spark, lost)
    maybe = rows.withColumn("_m", there(F.xxhash64("row")))
    lists = lost.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("lost"))
    kind = "array<struct<lo:bigint,hi:bigint>>"
    some = maybe.filter("_m").drop("_m").join(lists, "row", "left").select("doc_id", "text", "lost")
    none = maybe.filter("not _m").select("doc_id", "text", F.lit(None).cast(kind).alias("lost"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lost").to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = merged([(s["lo"], s["hi"]) for s in spans or ()])
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((name, len(data), len(data) - len(kept), len(gone), [{"lo": a, "hi": b} for a, b in gone], kept))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, spans {kind}, kept binary"
    return some.unionByName(none).mapInArrow(cut, schema)

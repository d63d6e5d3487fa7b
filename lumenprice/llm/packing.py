"""Best-fit packing of token sequences (operator 10): a configuration LP over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, positions, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ids of so many words are remembered by each Python worker; then it starts anew. Longer words aren't remembered.
REMEMBERED, WORD_BYTES = 400_000, 48

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
#: Letters or marks alone, after a blank or not, are one piece of the pattern (an apostrophe may start one of its own).
ONE_PIECE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: The characters by which byte-level BPE writes bytes: printable ones are themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def part_starts(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where parts of UTF-8 texts begin: at a run of ASCII white space that isn't behind other Unicode white space, and at a mark behind an ASCII letter or digit.

    Byte-level BPE's pattern lets no piece go on there and looks no further ahead than a run of white space and
    the character after it. So the ids of a text are those of its parts.
    """
    space = SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    lead = data[np.maximum(at - 3, 0)]
    # C2 85, C2 A0; E1 9A 80, E2 80 xx, E2 81 xx, E3 80 xx hold all others (and some that are no white space)
    wide = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (last >= 0x80) & ((lead == 0xE1) & (before == 0x9A) | (lead == 0xE2) & ((before == 0x80) | (before == 0x81)) | (lead == 0xE3) & (before == 0x80))
    return np.concatenate([at[~wide], np.flatnonzero(mark[data[1:]] & ALNUM[data[:-1]]) + 1])


class Ids:
    """Ids of texts by the tokenizer file at path, its special tokens included.

    Texts are cut into parts (see part_starts), every different part of a batch is encoded once, and the
    parts' ids are gathered in the order of the texts. A file that isn't plain byte-level BPE encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.mark = MARK.copy()
        self.mark[[b for t in added for b in t.content.encode()]] = False  # an added token stays in one part
        before = self.tokenizer.pre_tokenizer
        self.by_part = type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex and self.tokenizer.normalizer is None
        self.by_part &= not any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in added)
        self.added = any(ONE_PIECE.fullmatch(t.content) for t in added)
        self.forget()

    def forget(self) -> None:
        """Known words; of the n-th, ids[start[n] : start[n + 1]]."""
        self.known: dict[bytes, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        """As encode; parts that are one piece skip the pattern."""
        out: list = [None] * len(parts)
        for i, p in enumerate(parts):
            text = p.decode("utf-8")
            out[i] = [t.id for t in self.tokenizer.model.tokenize(p.decode("latin-1").translate(BYTE_CHARACTERS))] if ONE_PIECE.fullmatch(text) and not self.added else text
        rest = [i for i, x in enumerate(out) if isinstance(x, str)]
        for i, ids in zip(rest, self.encode([out[i] for i in rest])):
            out[i] = ids
        return out

    def learn(self, words: list[bytes]) -> None:
        found = self.encode_parts(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found])])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), and where each text's begin and end."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not self.by_part:
            found = self.encode([t or "" for t in texts.to_pylist()])
            np.cumsum([len(f) for f in found], out=bounds[1:])
            return np.fromiter(chain.from_iterable(found), np.uint32), bounds
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = pa.concat_arrays([texts.drop_null()])
        held, (first, last) = whole.buffers()[2], np.frombuffer(whole.buffers()[1], np.int32)[[whole.offset, whole.offset + len(whole)]]
        data = np.frombuffer(held, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        ends = np.cumsum(sizes)
        if not len(data):
            return np.empty(0, np.uint32), bounds
        cuts = np.sort(np.concatenate([[0], part_starts(data, self.mark), ends]))
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        words = parts.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if new := [i for i in np.flatnonzero(at < 0).tolist() if len(words[i]) <= WORD_BYTES]:
            at[new] = len(self.known) + np.arange(len(new))
            self.learn([words[i] for i in new])
        starts, ids = self.start, self.ids
        if len(long := np.flatnonzero(at < 0)):
            at[long] = len(self.known) + np.arange(len(long))
            found = self.encode_parts([words[i] for i in long.tolist()])
            starts = np.concatenate([starts, starts[-1] + np.cumsum([len(f) for f in found])])
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        at = at[parts.indices.to_numpy()]
        n = starts[at + 1] - starts[at]
        before = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])]
        bounds[1:] = before[np.searchsorted(cuts, ends)]
        return out, bounds


IDS: dict[str, Ids] = {}
ZERO = np.zeros(1, "<u4")


def pieces_of(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's little-endian ids, the separator id 0 included."""
    n = len(ids)
    start = 0
    for piece in range(-(-n // most)):
        end = n - (-(-n // most) - 1 - piece) * most
        yield piece, start, end - start, zlib.crc32(ids[start:end])
        start = end


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048) -> DataFrame:
    """Pieces of at most most tokens: doc_id, piece, start, length, ids_crc32. A null text is empty.

    A document is its ids and then id 0; only a longer one is cut, and only its first piece may be
    shorter than most. Every row of docs gives at least one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = IDS.get(tokenizer) or IDS.setdefault(tokenizer, Ids(tokenizer))
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(names):  # a MB at a time, however long the texts are
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 1_000_000)))
                found, bounds = ids.of(batch.column(1).slice(at, end - at))
                found = found.astype("<u4", copy=False)
                for name, a, b in zip(names[at:end], bounds.tolist(), bounds[1:].tolist()):
                    rows += [(name, *p) for p in pieces_of(np.append(found[a:b], ZERO), most)]
                at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), PIECES)


def knapsack(worth: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth within each capacity 0..most, any number of each length; and the length taken last (-1: none)."""
    best, last = np.zeros(most + 1), np.full(most + 1, -1)
    for c in range(int(lengths[0]), most + 1):
        fit = lengths[: np.searchsorted(lengths, c, "right")]
        value = best[c - fit] + worth[: len(fit)]
        i = int(value.argmax())
        if value[i] > best[c - 1]:
            best[c], last[c] = value[i], i
        else:
            best[c], last[c] = best[c - 1], -2  # leave one unit empty
    return best, last


def filled(room: int, last: np.ndarray, lengths: np.ndarray) -> list[int]:
    out = []
    while room > 0 and last[room] != -1:
        i = last[room]
        if i == -2:
            room -= 1
        else:
            out.append(int(i))
            room -= int(lengths[i])
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, most: int, share: float = 1 / 12, rounds: int = 400) -> dict[tuple[int, ...], float]:
    """A fractional solution of the covering LP: how often each configuration of length indices is used.

    Multiplicative weights: the worth of a length grows as it lags behind in coverage. A round solves the
    knapsack once for the worths and takes, for each length, the best configuration that holds it if its
    worth is close to the best of all; in a round no length is covered by more than its share, and
    in all none by more than its count. It ends when all are covered, or after rounds.
    """
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    eta, slack = 4.0, 0.01
    for _ in range(rounds):
        left = np.flatnonzero(counts - covered > 1e-9)
        if not len(left):
            break
        size, lag = lengths[left], covered[left] / counts[left]
        worth = size / most * np.exp(-eta * (lag - lag.mean()))
        best, last = knapsack(worth, size, most)
        value = worth + best[most - size]
        room = np.minimum(counts[left] * share, counts[left] - covered[left])
        limit = (1 - slack) * value.max()
        for i in np.argsort(-value, kind="stable"):
            if value[i] < limit:
                break
            if room[i] <= 0:
                continue
            kinds, times = np.unique([i, *filled(most - int(size[i]), last, size)], return_counts=True)
            step = float((room[kinds] / times).min())
            if step > 0:
                used[tuple(left[np.repeat(kinds, times)].tolist())] += step
                room[kinds] -= step * times
                covered[left[kinds]] += step * times
    return used


def best_fit(lengths: np.ndarray, left: np.ndarray, most: int, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts, also into bins that are begun: a step places as many pieces of a length as there are equal bins."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for config, n in begun:
        bins[most - int(lengths[list(config)].sum())].append((config, n))
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(left[i])
        while n:
            room = next((r for r in range(size, most) if bins.get(r)), None)
            if room is None:
                each = min(most // size, n)
                new = n // each
                bins[most - each * size].append(((i,) * each, new))
                n -= new * each
                continue
            held, m = bins[room].pop()
            each = min(room // size, max(1, n // m))
            take = min(m, n // each)
            if take < m:
                bins[room].append((held, m - take))
            bins[room - each * size].append((held + (i,) * each, take))
            n -= take * each
    return [b for of in bins.values() for b in of]


def taken(used: dict[tuple[int, ...], float], kinds: np.ndarray, left: np.ndarray, up: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of a fractional solution's configurations over kinds, most used first, as far as left has pieces; left is changed."""
    out = []
    for config, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        own, each = np.unique(kinds[list(config)], return_counts=True)
        n = int(min(times + up, (left[own] // each).min()))
        if n:
            out.append((tuple(np.repeat(own, each).tolist()), n))
            left[own] -= n * each
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, most: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations (tuples of length indices) that hold every piece exactly once.

    The fractional solution is rounded down, what is left is solved and rounded again, and the last pieces go
    to the fullest configurations that have room for them. Of several roundings that which needs the fewest
    sequences is taken; the last one keeps no configuration, so that none is worse than best fit alone.
    """
    whole, left = [], counts.astype(np.int64).copy()
    full = lengths == most
    whole += [((int(i),), int(left[i])) for i in np.flatnonzero(full) if left[i]]
    left[full] = 0
    plans = []
    kinds = np.flatnonzero(left)
    first = configurations(lengths[kinds].astype(np.int64), left[kinds].astype(float), most, rounds=rounds) if len(kinds) else {}
    for up, again in ((0.0, True), (0.5, False), (None, False)):
        own, out = left.copy(), []
        if up is not None:
            out += taken(first, kinds, own, up)
        rest = np.flatnonzero(own)
        if again and len(rest):
            used = configurations(lengths[rest].astype(np.int64), own[rest].astype(float), most, rounds=rounds // 4)
            out += taken(used, rest, own, 0.5)
        plans.append(best_fit(lengths, own, most, out))
    return whole + min(plans, key=lambda p: sum(n for _, n in p))


def pack_pieces(pieces: DataFrame, most: int = 2048, rounds: int = 400) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to most; sequences hold at most most tokens.

    Only the histogram of lengths, at most most rows, comes to the driver; the configurations go
    back as a table of (length, first position among the pieces of that length) of bounded size,
    and each piece finds its place by its position among the pieces of its length.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = np.array(sorted(counts), np.int64)
    configs = plan(lengths, np.array([counts[x] for x in lengths.tolist()], np.int64), most, rounds) if counts else []
    taken, slots, base = np.zeros(len(lengths), np.int64), [], 0
    for config, times in configs:
        offset = 0
        for i in reversed(config):
            slots.append((int(lengths[i]), int(taken[i]), base, offset))
            taken[i] += times
            offset += int(lengths[i])
        base += times
    slots.sort()
    table = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*slots)) if slots else None)
    wide = int(max(taken, default=0)) + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if table.value is None:
            return
        length, first, start, offset = table.value
        keys = length * wide + first
        for batch in batches:
            own, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place"))
            at = np.searchsorted(keys, own * wide + place, "right") - 1
            columns = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(start[at] + place - first[at]), "offset": pa.array(offset[at])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    names = pieces.columns
    placed = positions(pieces, ["length"], [c for c in names if c != "length"], "place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return placed.select(*names, "place").mapInArrow(giving_back(find), schema)


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, rounds: int = 400) -> DataFrame:
    """Packs the tokens of docs (doc_id, text) into few sequences of at most most tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are the single id 0; repeated rows are packed each; an empty table gives no rows; other
    columns don't matter.
    """
    return pack_pieces(staged(token_pieces(docs, tokenizer, most), "pack-pieces"), most, rounds)

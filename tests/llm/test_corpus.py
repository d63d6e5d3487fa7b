"""Mixing, toxicity, sharding and packing, and the pipeline of all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenprice.llm import mixing, packing, sharding, toxicity

from .conftest import words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing out the excess again and again."""
    total, out, full = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        rest = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i % len(weights)] for i in rest)
        out = [most * sizes[i] if i in full else left * weights[i % len(weights)] / w for i in range(len(sizes))]
        over = {i for i in rest if out[i] > most * sizes[i]}
        if not over:
            return out
        full |= over


def test_mixing(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 30)))) for i in range(400)] + [(900, None), (901, ""), (902, " \t"), (5, "twice twice"), (5, "twice twice")]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 11 < 3, "").when(F.col("doc_id") % 11 < 4, "é").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 11)))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, level([sizes[s] for s in order], mixing.WEIGHTS)))
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        taken[r["source"]] += r["taken"]
    for s in order:
        spread = sum(r["size"] ** 2 for r in found if r["source"] == s) ** 0.5
        assert abs(taken[s] - want[s]) <= 2.5 * spread
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in found)
    emitted = mixing.mixed_documents(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_toxicity(spark, make_docs):
    rng = random.Random(3)
    bad = ["zzidiotq", "qqscumzz", "xxmoronx"]
    rows, labels = [], []
    for i in range(900):
        own = words(rng, rng.randrange(3, 60), 300)
        toxic = i % 6 == 0
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(bad)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = make_docs([*rows, (2000, None), (2001, ""), (2002, "x" * 50_000)])
    table = spark.createDataFrame([(i, None, t) for i, t in labels] + [(1, 0, None), (5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.classify(docs, table).collect()}
    assert len(found) == 903 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(found[i]["score"], t) for i, t in labels if found[i]["held_out"]]
    right = sum((found[i]["predicted"] == t) for i, t in labels if found[i]["held_out"])
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    # held-out labels teach nothing
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.classify(docs, flipped).collect()} == {i: r["score"] for i, r in found.items()}
    nothing = toxicity.classify(docs, table.limit(0)).collect()
    assert len(nothing) == 903 and len({r["score"] for r in nothing}) == 1
    assert toxicity.classify(docs.limit(0), table).count() == 0


def test_sharding(make_docs):
    rng = random.Random(4)
    hot = " ".join(words(rng, 40))
    rows = [(i, hot if i % 3 == 0 else " ".join(words(rng, rng.randrange(1, 120)))) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "é" * 3000), (1, "same id")]
    found = sharding.shard(make_docs(rows), 16).collect()
    assert len(found) == len(rows)
    total, slots = Counter(), defaultdict(list)
    for r in found:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    mean = sum(total.values()) / 16
    assert max(total.values()) <= 1.05 * mean and min(total.values()) >= 0.95 * mean
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    assert sharding.shard(make_docs(rows).limit(0), 16).count() == 0


def test_groups_stay_whole(make_docs, monkeypatch):
    """Only a text that fits into no shard is in several; bytes are near equal, also with null ids and many tasks."""
    monkeypatch.setattr(sharding, "TASK_GROUPS", 300)
    rng = random.Random(5)
    body = lambda n: " ".join(words(rng, n))
    groups = [[body(200)] * 40, [body(30)] * 60, [body(400)] * 3, [body(100)] * 220]  # the last is above a shard
    rows = [(None if i % 50 == 0 else i, t) for i, t in enumerate([t for g in groups for t in g] + [body(rng.randrange(5, 90)) for _ in range(2500)])]
    found = sharding.shard(make_docs(rows), 16).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in found) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    size, where = Counter(), defaultdict(set)
    for r in found:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 16
    assert all(abs(n - mean) <= 0.03 * mean for n in size.values())  # texts are up to a hundredth of a shard here
    for text, n in Counter(t for _, t in rows).items():
        assert len(where[zlib.crc32(text.encode())]) == 1 or n * (len(text) + 1) > mean


def test_place_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes, room = rng.random((12, 3)) / 12, np.full((4, 3), 0.25)
        found = sharding.place(sizes, left := room.copy(), whole=True)
        free = room.copy()
        for i in sorted(range(12), key=lambda i: (-max(sizes[i]), i)):
            best = [s for s in range(4) if free[s][0] >= sizes[i][0]]
            want = max(best, key=lambda s: (sum(free[s] * sizes[i]), -s)) if best else -1
            assert found[i] == want
            if want >= 0:
                free[want] -= sizes[i]
        assert np.allclose(left, free)


ODD = ["", " ", "\n", "a\n\nb", " a", "a ", "it's 's don't're", "foo.\nBar, x!? 12,5 a.", "tab\there", "été, naïve. ﬁ", "日本語 テスト。", "<|endoftext|> a", "a.. b,, c.", "a  b", "\x1c a\x85b", "I'll.", "x' s", "a \nb"]


ODD += ["a <|endoftext|> b", "x<|endoftext|>y ", "”  b", "\u3000 \u3000x", "a\r\n b \x0b\x0c c", "a|b <|x|> <| endoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    """The contract's tokenizer, as loaded and left alone."""
    return Tokenizer.from_file(TOKENIZER)


@given(st.lists(st.text("ab.,! \n'é1 \t\x85|<", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_part_wise_ids_are_the_tokenizers(tokenizer, texts):
    ids = packing.IDS.get(TOKENIZER) or packing.IDS.setdefault(TOKENIZER, packing.Ids(TOKENIZER))
    assert ids.by_part
    found, bounds = ids.of(pa.array([*texts, None, *ODD], pa.string()))
    assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "", *ODD]]


def lower_bound(sizes, most):
    """Martello and Toth's L2: no packing has fewer sequences."""
    best = 0
    for least in {0, *(s for s in sizes if 2 * s <= most)}:
        alone = sum(s > most - least for s in sizes)
        large = [s for s in sizes if most - least >= s > most / 2]
        rest = sum(s for s in sizes if least <= s <= most / 2)
        best = max(best, alone + len(large) + max(0, -(-(rest - sum(most - s for s in large)) // most)))
    return best


def check_packing(found, want, most):
    """found: rows of pack; want: Counter of (doc_id, ids)."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    for doc_id, rows in by_doc.items():
        ids = [np.asarray([*w, 0], "<u4") for d, w in want.elements() if d == doc_id]
        pieces = Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        expected = Counter()
        for x in ids:
            n = -(-len(x) // most)
            ends = [len(x) - most * (n - 1 - p) for p in range(n)]
            expected.update((p, s, e - s, zlib.crc32(x[s:e].tobytes())) for p, (s, e) in enumerate(zip([0, *ends], ends)))
        assert pieces == expected
    assert len(by_doc) == len({d for d, _ in want})
    return len(sequences)


def test_packing(spark, make_docs, tokenizer):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.choice([2, 10, 40, 90, 150, 700]))) for _ in range(120)] + ODD + [None, "a" * 9000]
    rows = [*enumerate(texts), (3, texts[3])]
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    found = packing.pack(make_docs(rows), TOKENIZER, most=256).collect()
    n = check_packing(found, want, 256)
    sizes = [r["length"] for r in found]
    assert n <= 1.01 * lower_bound(sizes, 256) + 1
    lengths, counts = np.unique(sizes, return_counts=True)
    assert n <= sum(c for _, c in packing.best_fit(lengths, counts, 256))
    assert packing.pack(make_docs(rows).limit(0), TOKENIZER).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
@settings(max_examples=50, deadline=None)
def test_plans_hold_every_piece_once(counts):
    lengths = np.array(sorted(counts))
    done = packing.plan(lengths, np.array([counts[x] for x in lengths.tolist()]), 60, rounds=20)
    used = Counter()
    for config, times in done:
        assert sum(int(lengths[i]) for i in config) <= 60 and times > 0
        for i in config:
            used[int(lengths[i])] += times
    assert used == Counter(counts)


def test_pipeline_rejects_what_the_classifier_calls_toxic(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        marks = [m for m in ("zza", "zzb", "zzc") if rng.random() < 0.4]
        rows.append((i, " ".join(words(rng, 12, 60) + marks), "en", "s", 0))
        labels.append((i, 1, int(rng.random() < (0.03, 0.3, 0.6, 0.9)[len(marks)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.classify(docs, table).collect()
    assert any(0.3 <= r["score"] < 0.5 for r in found)
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path)).collect()}
    assert kept == {r["doc_id"] for r in found if not r["predicted"]}


def test_pipeline(spark, tmp_path, tokenizer):
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(20, 90), 5000)) for _ in range(90)]
    passage = " ".join(words(rng, 70, 10**6))
    rows, labels = [], []
    for i in range(160):
        t = base[i % 90] if i < 110 else " ".join(words(rng, rng.randrange(20, 60), 5000))
        if i % 8 == 1:
            t = f"{t} zzidiotq {t[:40]}"
        if i in (112, 114, 122):
            t = f"{' '.join(words(rng, 60, 5000))} {passage} {' '.join(words(rng, 60, 5000))}"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, int(i % 8 == 1)))
    rows += [(200, None, "en", None, 0), (201, "", "de", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in kept[n]} for n in kept}
    toxic = {i for i in range(160) if i % 8 == 1}
    assert ids["toxicity"] == set(range(160)) - toxic | {200, 201}
    seen, first = set(), set()
    for i, t, *_ in rows:
        if i in ids["toxicity"] and (t or "") not in seen:
            seen.add(t or "")
            first.add(i)
    assert ids["simhash_near_dedup"] == first
    texts = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    assert passage in texts[112] and not any(passage[100:300] in texts[i] for i in (114, 122))
    assert all(texts[i] == dict((r[0], r[1]) for r in rows)[i] for i in texts if i not in (114, 122))
    rates = mixing.mix(spark.read.parquet(f"{tmp_path}/substring_dedup")).collect()
    assert Counter(r["doc_id"] for r in kept["mixing"]) == Counter({r["doc_id"]: r["copies"] for r in rates if r["copies"]})
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in kept["mixing"])
    check_packing(kept["best_fit_packing"], want, 2048)
    size = sum(len(re.findall(r"\S+", r["text"] or "")) for r in kept["substring_dedup"])
    assert sum(len(re.findall(r"\S+", r["text"] or "")) for r in kept["mixing"]) == pytest.approx(1.5 * size, rel=0.2)

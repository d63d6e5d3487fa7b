"""SimHash groups and chained passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenprice.llm import chaining, simhash
from lumenprice.llm.components import components

from .conftest import words


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 440)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert found == {n: r for n, r in want.items() if n != r}


def plain_fingerprint(text):
    own = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(2)
    base = [words(rng, n) for n in (300, 200, 60, 12, 3)]
    out = ["", None, " \n\t", "One", "one", "A b", "a  B c", "ÀB ab"]
    for b in base:
        for k in (0, 0, 1, 1, 2, 5):
            own = list(b)
            for _ in range(k):
                own[rng.randrange(len(own))] = "edit"
            out.append(" ".join(own).title() if k == 1 else " ".join(own))
    return out + [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(60)]


@pytest.mark.parametrize("block", [20_000, 3])
def test_simhash(make_docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 3: keys are dealt out as pairs of blocks
    rows = [(10 * i, t) for i, t in enumerate(near_texts())]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = union([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], list(prints))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert found == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(make_docs(rows), 3, 3).collect()}
    assert kept == {i for i in prints if want[i] == i}


def test_wider_threshold_needs_unequal_parts():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for most in (3, 7):
        plan = simhash.probe_plan(sample, most, 200_000)
        # any difference of most bits is met by some part's threshold
        widths = [(m, max(bin(d).count("1") for d in diff)) for m, diff in plan]
        assert sum(t + 1 for _, t in widths) >= most + 1
        for _ in range(200):
            d = sum(1 << int(b) for b in rng.choice(64, most, replace=False))
            assert any(bin(d & m).count("1") <= t for m, t in widths)


def test_repeated_rows_and_empty(make_docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "z y x w v"), (None, "a b c d"), (2, None)]
    assert simhash.near_duplicates(make_docs(rows)).count() == 5
    assert simhash.without_near_duplicates(make_docs(rows), 3, 3).count() == 3
    assert simhash.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_near_copies_by_similarity(spark, make_docs):
    rng = random.Random(16)
    texts = []
    for n in [9, 14, 30, 60, 120, 250, 500] * 8:
        base = words(rng, n, 10**6)
        texts.append(base)
        for share in (0.02, 0.03, 0.05, 0.08):  # similarities from about 0.4 to 0.9
            texts.append([f"e{rng.random()}" if rng.random() < share else w for w in base])
        texts.append(base[: n - n // 9])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, min(len(texts), a + 6))}
    assert sum(0.8 <= v < 0.9 for v in pairs.values()) > 40 and sum(0.6 <= v < 0.8 for v in pairs.values()) > 40
    want = union([p for p, v in pairs.items() if v >= 0.8], range(len(texts)))
    docs = make_docs([" ".join(t) for t in texts] + [None, " "])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in want if want[i] == i} | {len(texts)}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_passages(make_docs):
    rng = random.Random(8)
    fresh = lambda n: words(rng, n, 10**6)
    passage, line = fresh(80), fresh(30)
    edited = list(passage)
    for i in (20, 41, 60):
        edited[i] = "edit"
    edited.insert(50, "more")
    texts = [
        fresh(40) + passage + fresh(30), fresh(100), fresh(10) + edited + fresh(25), passage, fresh(60) + passage[:45] + fresh(60), line * 4, fresh(5) + line * 4,
        fresh(200), [], None, fresh(3), [w.upper() for w in passage],
    ]
    docs = make_docs([None if t is None else " ".join(t) for t in texts])
    found = {r["doc_id"]: r for r in chaining.without_passages(docs).collect()}
    assert [found[i]["n_passages"] for i in range(12)] == [0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    assert {i: found[i]["component_id"] for i in range(12) if found[i]["component_id"] != i} == {2: 0, 3: 0, 11: 0, 6: 5}
    assert found[3]["kept"] == "" and found[9]["kept"] is None and found[1]["kept"] == " ".join(texts[1])
    kept = found[2]["kept"].split()
    assert kept[:10] == texts[2][:10] and kept[-25:] == texts[2][-25:] and len(kept) <= 40
    dropped = chaining.drop_passages(docs)
    assert dropped.columns == docs.columns and {r["doc_id"] for r in dropped.collect()} == set(range(12)) - {3, 11}
    assert all(r["n_chars"] == len(r["text"] or "") for r in dropped.collect())
    assert chaining.without_passages(docs.limit(0)).count() == 0


def test_exact_repeats_are_all_found(make_docs):
    rng = random.Random(9)
    passages = [words(rng, n, 10**6) for n in (55, 70, 120, 64)]
    texts = [words(rng, rng.randrange(5, 60), 300) + rng.choice(passages) + words(rng, rng.randrange(5, 60), 300) for _ in range(60)]
    found = {r["doc_id"]: r["kept"].split() for r in chaining.without_passages(make_docs([" ".join(t) for t in texts])).collect()}
    seen = set()
    for i, t in enumerate(texts):
        own = next(k for k, p in enumerate(passages) if p[5] in t)
        again = set(passages[own][3:-3]) & set(found[i])
        assert bool(again) == (own not in seen)
        seen.add(own)


def test_verbatim_repeats_behind_partial_ones(make_docs):
    rng = random.Random(12)
    texts, whole = [], []
    for _ in range(12):
        p = words(rng, 60, 10**6)
        for own in (p[:36], p[24:], p, p[:36], p[24:], p):
            texts.append(words(rng, 30, 10**6) + own + words(rng, 30, 10**6))
        whole.append(len(texts) - 1)
    docs = make_docs([" ".join(t) for t in texts])
    for found in (docs, docs.coalesce(1)):
        kept = {r["doc_id"]: r["kept"].split() for r in chaining.without_passages(found).collect()}
        assert {i: kept[i] for i in kept} == {i: t[:30] + t[-30:] if i in whole else t for i, t in enumerate(texts)}


def test_verbatim_repeats_just_over_the_bound(make_docs):
    rng = random.Random(13)
    texts = []
    for n in [49, 50, 51, 52, 53, 54] * 20:
        p = words(rng, n, 10**6)
        texts += [words(rng, 20, 10**6) + p + words(rng, 20, 10**6) for _ in range(2)]
    kept = {r["doc_id"]: r["kept"].split() for r in chaining.without_passages(make_docs([" ".join(t) for t in texts])).collect()}
    for i, t in enumerate(texts):
        if i % 2 and len(t) >= 90:  # a word beside it may go where its hash of 7 bits is equal
            assert not set(t[20:-20]) & set(kept[i]) and len(kept[i]) >= 38
        else:
            assert kept[i] == t


def test_fuzzy_passages_by_aligned_words(make_docs):
    rng = random.Random(14)
    texts = []
    for k in [9, 10, 12] * 8:
        p = words(rng, 120, 10**6)
        texts += [words(rng, 30, 10**6) + p + words(rng, 30, 10**6), words(rng, 30, 10**6) + [f"z{rng.random()}" if i % k == k // 2 else w for i, w in enumerate(p)] + words(rng, 30, 10**6)]
    found = {r["doc_id"]: r["n_removed"] for r in chaining.without_passages(make_docs([" ".join(t) for t in texts])).collect()}
    assert sum(found[i] >= 0.9 * 120 for i in range(1, len(texts), 2)) >= 23
    assert not any(found[i] for i in range(0, len(texts), 2))


def test_passage_before_a_part_that_is_less_alike(make_docs):
    rng = random.Random(15)
    texts = []
    for _ in range(12):  # 60 words with four edits, and a tail that is not alike enough
        a = words(rng, 60, 10**6)
        b = [f"z{i}" if i % 15 == 7 else w for i, w in enumerate(a)]
        for _ in range(8):
            same = words(rng, 14, 10**6)
            a, b = a + words(rng, 9, 10**6) + same, b + words(rng, 9, 10**6) + same
        texts += [words(rng, 30, 10**6) + a, words(rng, 30, 10**6) + b]
    found = {r["doc_id"]: r["n_removed"] for r in chaining.without_passages(make_docs([" ".join(t) for t in texts])).collect()}
    assert all(found[i] >= 0.9 * 60 for i in range(1, len(texts), 2))
    assert not any(found[i] for i in range(0, len(texts), 2))


@pytest.mark.parametrize("share", [50, 25])
def test_fuzzy_passages_behind_parts_of_them(make_docs, share):
    """Earlier documents with halves of a passage, each too short to count, don't hide the one that has all of it."""
    rng = random.Random(18)
    texts, last = [], []
    for _ in range(20):
        p = words(rng, 80, 10**6)
        again = [f"z{rng.random()}" if i % share == share // 2 else w for i, w in enumerate(p)]
        for own in (p[:45], p[35:], p, p[:45], p[35:], again):
            texts.append(" ".join(words(rng, 30, 10**6) + own + words(rng, 30, 10**6)))
        last.append(len(texts) - 1)
    found = {r["doc_id"]: r["n_removed"] for r in chaining.without_passages(make_docs(texts)).collect()}
    assert sum(found[i] >= 70 for i in last) >= 19
    assert not any(found[i] for i in found if i not in last)


def test_fuzzy_passages_behind_many_parts_of_them(make_docs):
    """However many rows have a passage's seeds, each is compared with all earlier ones."""
    rng = random.Random(21)
    texts, last = [], []
    for _ in range(3):
        p = words(rng, 80, 10**6)
        texts += [" ".join(words(rng, 30, 10**6) + own + words(rng, 30, 10**6)) for _ in range(60) for own in (p[:45], p[35:])]
        texts.append(" ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6)))
        texts += [" ".join(words(rng, 30, 10**6) + own + words(rng, 30, 10**6)) for _ in range(60) for own in (p[:45], p[35:])]
        for _ in range(8):
            again = [f"z{rng.random()}" if i % 25 == 12 else w for i, w in enumerate(p)]
            texts.append(" ".join(words(rng, 30, 10**6) + again + words(rng, 30, 10**6)))
            last.append(len(texts) - 1)
    found = {r["doc_id"]: r["n_removed"] for r in chaining.without_passages(make_docs(texts)).collect()}
    assert sum(found[i] >= 70 for i in last) >= 23
    assert not any(found[i] for i in found if i not in last)


def test_blocks_find_what_links_find(make_docs, monkeypatch):
    """Runs that are compared in pairs of blocks, or in part, give what links of all seeds give."""
    rng = random.Random(22)
    passages, line = [words(rng, n, 10**6) for n in (60, 90, 150, 40)], words(rng, 25, 10**6)
    texts = []
    for i in range(160):
        own = [f"e{rng.random()}" if rng.random() < 0.04 else w for w in passages[i % 4][: rng.choice((35, 150))]]
        texts.append(" ".join(words(rng, rng.randrange(5, 40), 300) + own + (line * 2 if i % 3 == 0 else []) + words(rng, rng.randrange(5, 40), 300)))
    docs = make_docs(texts + [texts[5]] * 3)
    found = []
    for hot, blocks in ((10**9, 4), (20, 4), (3, 7)):
        monkeypatch.setattr(chaining, "HOT", hot)
        monkeypatch.setattr(chaining, "BLOCKS", blocks)
        found.append(sorted(map(tuple, chaining.without_passages(docs).collect()), key=str))
    assert found[0] == found[1] == found[2] and sum(r[3] > 30 for r in found[0]) > 40


def test_near_copies_within_the_pigeonholes_bits(make_docs, monkeypatch):
    """All pairs within NEAR bits are candidates without any draw."""
    rng = random.Random(19)
    texts = []
    for n in [60, 120, 250] * 20:
        base = words(rng, n, 10**6)
        texts += [base, [f"e{rng.random()}" if i == n // 2 else w for i, w in enumerate(base)], words(rng, n, 10**6)]
    docs = make_docs([" ".join(t) for t in texts])
    lanes = {r["row"]: r["lane"] for r in simhash.shingled(docs.select(F.col("doc_id").alias("row"), "text"), 5).collect()}
    within = [k for k in range(0, len(texts), 3) if ((lanes[k] ^ lanes[k + 1]) & (1 << 64) - 1).bit_count() <= simhash.NEAR]
    monkeypatch.setattr(simhash, "candidate_links", lambda texts, similar: texts.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect()}
    assert len(within) > 40 and not kept & {k + 1 for k in within}
    assert kept >= set(range(0, len(texts), 3)) | set(range(2, len(texts), 3))


def test_chain_prefers_the_longer_order():
    x, y = np.array([0, 5, 10, 15, 20, 25]), np.array([100, 105, 3, 110, 115, 9])
    best = chaining.chain(x, y)[0]
    assert best.tolist() == [0, 1, 3, 4]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_passages_do_not_depend_on_the_layout(make_docs, monkeypatch, hot):
    monkeypatch.setattr(chaining, "HOT", hot)
    rng = random.Random(16)
    passages = [words(rng, n, 10**6) for n in (60, 90, 150)] + [words(rng, 30, 10**6)]
    texts = []
    for i in range(240):
        own = [f"e{rng.random()}" if rng.random() < 0.06 else w for w in passages[i % 4]]
        texts.append(" ".join(words(rng, rng.randrange(5, 60), 400) + own + words(rng, rng.randrange(5, 60), 400)))
    docs = make_docs(texts + texts[:40] + [None, ""] + [texts[7]] * 9)
    one, four, many = (sorted(map(tuple, chaining.without_passages(docs.repartition(n)).collect()), key=str) for n in (1, 4, 40))
    assert one == four == many
    # the first texts stay, most edited passages go, and short lines stay
    lost = {r[0]: r[3] for r in one}
    assert not any(lost[i] for i in (0, 1, 2)) and not any(lost[i] for i in range(3, 240, 4))
    assert sum(lost[i] >= 0.8 * len(passages[i % 4]) for i in range(4, 240) if i % 4 < 3) >= 0.9 * 177
    assert all(lost[240 + i] == len(texts[i].split()) for i in range(40) if len(texts[i].split()) >= 50)


def shuffled(spark, run):
    """MB that the stages of run write to shuffles."""
    store, last = spark.sparkContext._jsc.sc().statusStore(), lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    began = last()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for i in range(began, last()):
        try:
            total += store.lastStageAttempt(i).shuffleWriteBytes()
        except Exception:  # a stage that was left out
            continue
    return total / 1e6


def test_links_are_shuffled_packed(spark, make_docs):
    rng = random.Random(20)
    passages = [words(rng, 200, 10**6) for _ in range(40)]
    texts = [" ".join(words(rng, 20, 10**6) + [f"e{rng.random()}" if rng.random() < 0.03 else w for w in passages[i % 40]]) for i in range(1600)]
    docs = make_docs(texts).cache()
    docs.count()
    found = []
    mb = shuffled(spark, lambda: found.extend(chaining.without_passages(docs).collect()))
    assert sum(r["n_removed"] > 180 for r in found) >= 1500
    assert mb < 25, mb  # 14; 42 as rows of five numbers


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_passages_against_brute_force(make_docs):
    """What goes is alike by edit distance to a part of an earlier text, and alike parts go."""
    rng = random.Random(17)
    pairs, texts = [], []
    for k in range(40):
        p = words(rng, rng.randrange(56, 130), 10**6)
        share = (0.02, 0.05, 0.08, 0.35)[k % 4]
        q = [x for w in p for x in ([w], [w], [f"z{rng.random()}"], [], [w, f"z{rng.random()}"])[rng.choice((2, 2, 3, 4)) if rng.random() < share else 0]]
        pairs.append((p, q))
        texts += [words(rng, 20, 10**6) + p + words(rng, 20, 10**6), words(rng, 20, 10**6) + q + words(rng, 20, 10**6)]
    found = {r["doc_id"]: r for r in chaining.without_passages(make_docs([" ".join(t) for t in texts])).collect()}
    found_of = []
    for k, (p, q) in enumerate(pairs):
        alike = 1 - edit_distance(p, q) / max(len(p), len(q))
        lost = found[2 * k + 1]["n_removed"]
        assert found[2 * k]["n_removed"] == 0
        if alike >= 0.85:
            found_of.append(lost >= 0.9 * len(q) - 4)
        elif alike < 0.7:
            assert lost < 0.9 * len(q)
    assert len(found_of) >= 25 and sum(found_of) >= 0.95 * len(found_of)

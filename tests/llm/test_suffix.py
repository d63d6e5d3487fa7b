"""Suffix arrays against plain sorting, and the removal of repeats against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenprice.llm import substring_exact
from lumenprice.llm.suffix import equal_to_next, suffix_array


@given(st.binary(max_size=80) | st.text("ab", max_size=120).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    found = suffix_array(text, 200).tolist()
    # a zero byte and the end of the text compare alike in the sorted words; suffixes that differ only so may come in any order
    assert sorted(found) == list(range(len(data)))
    keys = [data[i:] + bytes(256) for i in found]
    assert keys == sorted(keys)


def test_equal_neighbours():
    text = np.frombuffer(b"abcdefghijabcdefghijx", np.uint8)
    array = suffix_array(text, 10)
    array = array[array <= len(text) - 10]
    same = equal_to_next(array, text, 10)
    assert [(int(a), int(b)) for a, b, s in zip(array, array[1:], same) if s] == [(0, 10)]


def brute(rows, most):
    """(n_bytes, n_removed, n_spans, kept's hash) of rows in order."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode())):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - most + 1):
            part = data[i : i + most]
            if part in seen:
                gone[i : i + most] = True
            seen.add(part)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [word(n) for n in (99, 100, 101, 150, 400)]
    out = ["", None, "x" * 700, "x" * 350, "ab" * 300, passages[4], passages[4]]
    out += [word(rng.randrange(200)) + rng.choice(passages) + word(rng.randrange(120)) + rng.choice(passages) for _ in range(40)]
    line = word(70)
    return out + [word(60) + line + word(60) for _ in range(30)] + [passages[4][:200] + "!" + passages[4][200:]]


@pytest.mark.parametrize("group", [20_000, 4])
def test_repeats(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(substring_exact, "GROUP", group)  # 4: keys are refined again and again
    rows = list(enumerate(texts(1)))
    found = sorted((tuple(r) for r in substring_exact.without_repeats(make_docs(rows), 100).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()))
    assert [f[1:] for f in found] == brute(rows, 100)


def test_ties_and_nulls(spark, make_docs):
    rows = [(None, "q" * 50 + "r" * 120), (7, "q" * 50 + "r" * 120), (7, "q" * 50 + "r" * 120), (7, "a" * 130), (3, "a" * 130), (None, None)]
    found = substring_exact.without_repeats(make_docs(rows), 100).selectExpr("n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, 100))
    assert substring_exact.without_repeats(make_docs(rows).limit(0), 100).count() == 0

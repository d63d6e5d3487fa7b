"""Base statistics and minimum-covariance-determinant outliers against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenprice.llm import outliers

from .conftest import words


def plain(text):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def vector(s):
    n = max(s[0], 1)
    v = [math.log(n), math.log(max(s[1], 1) / n), math.log(1 + 10 * s[2] / n), s[4] / max(s[3], 1), s[5] / n]
    return [math.floor(x * outliers.UNIT + 0.5) for x in v]


def distances(x, mean, cov, scale=1.0):
    c = cov * scale
    np.fill_diagonal(c, np.maximum(np.diag(c), 0) + (np.array(outliers.SPREAD) * outliers.UNIT) ** 2)
    r = x - mean
    return np.einsum("ij,jk,ik->i", r, np.linalg.inv(c), r), np.linalg.slogdet(c)[1]


def covariance(x):
    return x.mean(axis=0), np.cov(x.T, bias=True)


def concentrated(x):
    """Location and covariance of the nearest rows, by steps from the two starts."""
    quartile = lambda v, s: (sorted(v)[math.ceil(s * len(v)) - 1] // outliers.COARSE + 0.5) * outliers.COARSE
    mid = np.array([quartile(v, 0.5) for v in x.T])
    wide = np.array([(quartile(v, 0.75) - quartile(v, 0.25)) / 1.3489795 for v in x.T])
    found = []
    for mean, cov in ((mid, np.diag(wide**2)), covariance(x)):
        for _ in range(outliers.STEPS):
            bins = np.floor(outliers.FINE * np.log2(1 + distances(x, mean, cov.copy())[0]))
            edge = np.sort(bins)[math.ceil(outliers.SHARE * len(x)) - 1]
            mean, cov = covariance(x[bins <= edge])
        found.append((distances(x, mean, cov.copy())[1], mean, cov))
    return min(found, key=lambda f: f[0])[1:]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for i in range(900):
        w = words(rng, rng.randrange(51, 300))
        if i % 17 == 0:
            w = [x + "###" for x in w]  # symbols
        if i % 23 == 0:
            w = [x * 3 for x in w]  # long words
        lines = [" ".join(w[j : j + 12]) for j in range(0, len(w), 12)]
        if i % 29 == 0:
            lines += lines[:3] * 2
        if i % 41 == 0:
            lines = lines[:1] * 40
        out.append((i, "\n".join(lines)))
    return [*out, (1000, None), (1001, ""), (1002, " \t\r\n\n"), (1003, "a b c a b c a"), (2005, "twice"), (2005, "twice"), (None, "x " * 60), (1004, "\u2003 é " * 70), (1005, "q" * 300_000 + " r" * 60)]


def test_statistics(make_docs, texts):
    found = outliers.statistics(make_docs(texts)).collect()
    want = Counter((i, *plain(t)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == want


@pytest.mark.parametrize("least", [200, 400])
def test_outliers(make_docs, texts, monkeypatch, least):
    """At 400 rows the sources of "en" are too small and are pooled; those of the other languages are kept unseen."""
    monkeypatch.setattr(outliers, "LEAST_ROWS", least)
    monkeypatch.setattr(outliers, "STEPS", 3)
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") % 31 == 0, None).otherwise(F.col("lang")))
    found = outliers.judged(docs).collect()
    stats = {(i, t): plain(t) for i, t in texts}
    groups = defaultdict(list)
    keys = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    sound = {i: s for (i, t), s in stats.items() if s[0] >= 50 and 2 * s[5] <= s[0]}
    for i, s in sound.items():
        groups[keys[i]].append(i)
    pools = defaultdict(list)
    for (lang, source), rows in groups.items():
        pools[(lang, source) if len(rows) >= least else (lang,)] += rows
    rest = [i for k, rows in pools.items() if len(k) == 1 and len(rows) < least for i in rows]
    chosen = [rows for k, rows in pools.items() if len(k) == 2 or len(rows) >= least]
    if len(rest) >= least:
        chosen.append(rest)
    want = {}
    for rows in chosen:
        x = np.array([vector(sound[i]) for i in rows], float)
        d = distances(x, *concentrated(x), outliers.CONSISTENT)[0]
        want |= dict(zip(rows, d))
    assert len(want) > 500
    for r in found:
        i = r["doc_id"]
        assert r["base_failed"] == (i not in sound)
        assert r["d"] == (pytest.approx(want[i], rel=1e-6) if i in want else None)
        assert r["kept"] == (i in sound and want.get(i, 0) <= outliers.CUT)
    bad = {i for i in range(0, 900, 17)} & set(want)
    assert bad and all(want[i] > outliers.CUT for i in bad)
    clean = {i for i in want if i and i < 900 and all(i % k for k in (17, 23, 29, 41))}
    assert sum(want[i] <= outliers.CUT for i in clean) == len(clean)
    if least == 400:
        return
    again = {(r["doc_id"], r["d"]) for r in outliers.judged(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["d"]) for r in found}


def test_empty(make_docs):
    docs = make_docs([(1, "a")])
    assert outliers.judged(docs.limit(0)).count() == 0
    assert [tuple(r) for r in outliers.judged(docs).select("doc_id", "base_failed", "kept").collect()] == [(1, True, False)]


def test_quantiles():
    assert outliers.chi2_below(14.0671, 7) == pytest.approx(0.95, abs=1e-5)
    assert outliers.chi2_at(0.99, 5) == pytest.approx(15.0863, abs=1e-3)

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of texts (or of (doc_id, text) pairs), with more columns whose names could clash."""

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"s{n % 3}" if n % 7 else None, len(t or ""), n, "x", 0.5) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, SCHEMA + ", row int, at string, score double").repartition(3)

    return make

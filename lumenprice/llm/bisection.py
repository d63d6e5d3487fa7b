"""Recursive graph bisection: a tree that orders documents so that those of like terms stand together."""

from __future__ import annotations

import numpy as np

#: Rounds of exchanges at each node.
ROUNDS = 12


def cost(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Bits that the gaps of each term's documents take in both halves, up to a constant."""
    return left * np.log2(n_left / (left + 1)) + right * np.log2(n_right / (right + 1))


def row_sums(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of weights over rows that begin at starts; none is empty."""
    return np.add.reduceat(weights, starts)


def halved(terms: np.ndarray, starts: np.ndarray, n_terms: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Two halves of the rows between which no exchange saves bits: which rows are right, and the weights and bias that tell so of any row.

    Rows of the halves are paired by what moving each would save, and exchanged while a pair saves something.
    """
    n = len(starts)
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(terms))))
    right = rng.permutation(n) >= (n + 1) // 2
    n_left, n_right = (n + 1) // 2, n // 2
    for _ in range(ROUNDS):
        left_degree = np.bincount(terms[~right[row]], minlength=n_terms).astype(float)
        right_degree = np.bincount(terms[right[row]], minlength=n_terms).astype(float)
        now = cost(left_degree, right_degree, n_left, n_right)
        to_right = now - cost(np.maximum(left_degree - 1, 0), right_degree + 1, n_left, n_right)
        to_left = now - cost(left_degree + 1, np.maximum(right_degree - 1, 0), n_left, n_right)
        saved = row_sums(np.where(right[row], to_left[terms], to_right[terms]), starts)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-saved[a], kind="stable")], b[np.argsort(-saved[b], kind="stable")]
        pairs = min(len(a), len(b))
        swaps = int((saved[a[:pairs]] + saved[b[:pairs]] > 1e-9).sum())
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    left_degree = np.bincount(terms[~right[row]], minlength=n_terms).astype(float)
    right_degree = np.bincount(terms[right[row]], minlength=n_terms).astype(float)
    # what a further row costs on the left beyond what it costs on the right
    weights = cost(left_degree + 1, right_degree, n_left, n_right) - cost(left_degree, right_degree + 1, n_left, n_right)
    sums = row_sums(weights[terms], starts)
    return right, weights.astype(np.float32), float(np.median(sums))


def tree(terms: np.ndarray, starts: np.ndarray, n_terms: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the 2^levels - 1 nodes of a bisection of rows of terms; node i has the nodes 2 i + 1 and 2 i + 2 below it."""
    rng = np.random.default_rng(11)
    weights, biases = np.zeros(((1 << levels) - 1, n_terms), np.float32), np.zeros((1 << levels) - 1, np.float32)
    ends = np.append(starts, len(terms))
    open_ = [(0, np.arange(len(starts)))]
    while open_:
        node, rows = open_.pop()
        if node >= len(biases) or len(rows) < 2:
            continue
        own = np.concatenate([terms[ends[r] : ends[r + 1]] for r in rows])
        sizes = ends[rows + 1] - ends[rows]
        right, weights[node], biases[node] = halved(own, np.cumsum(sizes) - sizes, n_terms, rng)
        open_ += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return weights, biases


def routed(weights: np.ndarray, biases: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The leaf, from 0 in the order of the bisection, that each row of terms goes to."""
    node = np.zeros(len(starts), np.int64)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
    while len(biases) and node[0] < len(biases):
        sums = row_sums(weights[node[row], terms], starts)
        node = 2 * node + 1 + (sums > biases[node])
    return node - len(biases)

"""Suffix arrays by two-stage sorting, and the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def words_of(text: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each position as a number that compares as they do, with zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + len(text)]
    return np.concatenate([word, np.zeros(depth, np.uint64)])


def sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first depth bytes, ties in the given order."""
    order = at[np.argsort(words[at], kind="stable")]
    group = np.concatenate([[0], np.cumsum(words[order[1:]] != words[order[:-1]])]) if len(order) else np.empty(0, np.int64)
    for skip in range(8, depth, 8):
        # only groups of more than one member go on
        same = np.zeros(len(order), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        own = words[order[tied] + skip]
        by = np.lexsort((own, group[tied]))
        order[tied] = order[tied][by]
        own = own[by]
        new = np.zeros(len(order), np.int64)
        new[tied[1:]] = (own[1:] != own[:-1]) & (group[tied[1:]] == group[tied[:-1]])
        new[1:] += group[1:] != group[:-1]
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (bytes) in the order of their suffixes by the first depth bytes or more.

    First stage: only suffixes that are smaller than their successor are sorted directly. Second
    stage: the others are induced by a scan of the buckets by first byte. The successor of such a suffix
    begins with a smaller byte, whose bucket is complete by then, or with the same byte; so within its bucket it follows the
    order of the successors, first those of smaller bytes, then run by run. They come before the
    directly sorted suffixes of their bucket, which are larger.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    # smaller than the successor: by the next different byte; the end of the text is smaller than all
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.zeros(n, bool)
    if len(change):
        up = text[change + 1] > text[change]
        rises[: change[-1] + 1] = np.repeat(up, np.diff(np.concatenate([[-1], change])))
    words = words_of(text, depth + 8)
    direct = sorted_directly(np.flatnonzero(rises), words, depth)
    size = np.bincount(text, minlength=256)
    first = np.concatenate([[0], np.cumsum(size)])
    size_direct = np.bincount(text[direct], minlength=256)
    first_direct = np.concatenate([[0], np.cumsum(size_direct)])
    out, rank = np.empty(n, np.int64), np.empty(n + 1, np.int64)
    rank[n] = -1
    falls = np.flatnonzero(~rises)
    falls = falls[np.argsort(text[falls], kind="stable")]
    first_falls = np.concatenate([[0], np.cumsum(size - size_direct)])
    for c in np.flatnonzero(size).tolist():
        own = falls[first_falls[c] : first_falls[c + 1]]
        at = first[c]
        same = np.zeros(len(own), bool)
        inner = own < n - 1
        same[inner] = text[own[inner] + 1] == c
        layer = own[~same]
        layer = layer[np.argsort(rank[layer + 1], kind="stable")]
        while len(layer):
            out[at : at + len(layer)] = layer
            rank[layer] = np.arange(at, at + len(layer))
            at += len(layer)
            layer = layer[layer > 0] - 1
            layer = layer[text[layer] == c]
        rest = direct[first_direct[c] : first_direct[c + 1]]
        out[at : at + len(rest)] = rest
        rank[rest] = np.arange(at, at + len(rest))
    return out


def equal_to_next(at: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """Whether the strings of depth bytes at neighbours of an ordered list are the same."""
    words = words_of(text, depth + 8)
    alive = np.arange(max(0, len(at) - 1))
    for skip in range(0, depth, 8):
        skip = min(skip, depth - 8)
        alive = alive[words[at[alive] + skip] == words[at[alive + 1] + skip]]
    same = np.zeros(max(0, len(at) - 1), bool)
    same[alive] = True
    return same

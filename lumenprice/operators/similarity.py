"""String similarities by insertions and deletions, in Arrow batches."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """The longest common subsequence's length, a bit a character of a (Hyyro, 2004)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & masks.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of its length of the longer one, or a shorter one at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = 0.0
    for lo in range(1 - len(a), len(b)):
        best = max(best, ratio(a, b[max(0, lo) : lo + len(a)]))
        if best == 100.0:
            break
    if len(a) == len(b):
        best = max([best, *(ratio(b, a[max(0, lo) : lo + len(b)]) for lo in range(1 - len(b), len(a)))])
    return best

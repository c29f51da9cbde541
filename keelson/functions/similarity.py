"""Similarity of column names: twice the longest common subsequence over both lengths."""

from __future__ import annotations

from functools import lru_cache

from .names import normalized

# Weights of join coverage and of names, and the least scores of the labels.
COVERAGE, NAMES = 0.34, 0.66
CONFIRMED, WEAK = 0.75, 0.25


def common_subsequence(a: str, b: str) -> int:
    """Its length, on bit rows: one big integer addition for each character."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(65536)
def name_similarity(left: str, right: str) -> float:
    a, b = normalized(left), normalized(right)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return round(2 * common_subsequence(a, b) / (len(a) + len(b)), 4)


def hybrid(ratio: float, similarities: list[float]) -> tuple[float, float, str]:
    """(mean similarity, score, label) of a join."""
    mean = sum(similarities) / len(similarities) if similarities else 0.0
    score = round(COVERAGE * ratio + NAMES * mean, 6)
    return mean, score, "CONFIRMED" if score >= CONFIRMED else "WEAK" if score <= WEAK else "COINCIDENCE"

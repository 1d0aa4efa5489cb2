"""Similarity of names: the common-subsequence ratio, on sorted and shared words, and a weighted mix of them.

All scores run from 0 to 100. Defined cases: two empty names are equal (100); one empty name scores 0; a
null name scores null in the column functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition over whole words of the machine."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common(a, b) / n


def sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(sorted_words(a), sorted_words(b))


def token_set(a: str, b: str) -> float:
    """Best ratio among the shared words, and the shared words with what either side has more."""
    x, y = set(a.split()), set(b.split())
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    s, u, v = " ".join(both), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    with_u, with_v = f"{s} {u}".strip(), f"{s} {v}".strip()
    return max(ratio(with_u, with_v), ratio(s, with_u) if s else 0.0, ratio(s, with_v) if s else 0.0)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter name with a stretch of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for at in range(1 - n, len(b)):
        piece = b[max(0, at) : at + n]
        if piece[-1] in a or piece[0] in a:
            best = max(best, ratio(a, piece))
            if best == 100.0:
                break
    return best


def partial_tokens(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 100.0 if x & y else partial(sorted_words(a), sorted_words(b))


def weighted(a: str, b: str) -> float:
    """The mix: plain ratio, ratios on words at 0.95, and partial ones scaled down where lengths differ much."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(ratio(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if apart < 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


def _column(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio_col, token_sort_col, weighted_col = _column(ratio), _column(token_sort), _column(weighted)
SCORES = {"ratio": ratio, "token_sort": token_sort, "weighted": weighted}

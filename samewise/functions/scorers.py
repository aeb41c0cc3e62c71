"""String similarity: plain functions of two strings, and Arrow UDFs over columns of pairs.

ratio compares by insertions and deletions alone: with d of them between texts of n characters together it
is (1 - d / n) * 100. The others derive from it as their docstrings say. Jaro and Jaro-Winkler lie in 0..1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from samewise.errors import MatchingError


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character (Hyyro, 2004)."""
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return (full ^ row).bit_count()


def _norm(d: int, n: int) -> float:
    return (1 - d / n) * 100 if n else 100.0


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return _norm(n - 2 * lcs(a, b), n)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length, or a shorter beginning or end, of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0

    def best(s: str, t: str) -> float:
        m, known, top = len(s), set(s), 0.0
        windows = [(i, i + m) for i in range(len(t) - m + 1)] + [(0, k) for k in range(1, m)] + [(len(t) - k, len(t)) for k in range(1, m)]
        for i, j in windows:
            if top == 100.0:
                break
            # a window whose open end is a character that s lacks is beaten by a neighbour
            if (t[j - 1] if i == 0 or j - i == m else t[i]) in known:
                top = max(top, ratio(s, t[i:j]))
        return top

    top = best(a, b)
    return max(top, best(b, a)) if len(a) == len(b) and top < 100.0 else top


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common tokens and either side's, and both sides' (common tokens first); 100 if one side has no other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    c, la, lb = len(both), len(only_a), len(only_b)
    gap = 1 if c else 0
    na, nb = c + gap + la, c + gap + lb
    top = _norm(la + lb - 2 * lcs(only_a, only_b), na + nb)
    return max(top, _norm(gap + la, c + na), _norm(gap + lb, c + nb)) if c else top


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    """partial_ratio of sorted tokens and of the tokens that are not common; 100 if a token is common."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    top = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(top, partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))) if len(x) < len(a.split()) or len(y) < len(b.split()) else top


def wratio(a: str, b: str) -> float:
    """ratio against discounted token and partial ratios, by how much the lengths differ."""
    if not a or not b:
        return 0.0
    r, longer = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(r, 0.95 * token_ratio(a, b))
    part = 0.9 if longer <= 8 else 0.6
    return max(r, part * partial_ratio(a, b), 0.95 * part * partial_token_ratio(a, b))


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swaps = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """jaro raised by a tenth of the rest per character of a common beginning (4 at most) where it exceeds 0.7."""
    j = jaro(a, b)
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return j + 0.1 * start * (1 - j) if j > 0.7 else j


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio,
    "WRatio": wratio, "jaro": jaro, "jaro_winkler": jaro_winkler,
}


def scorer(name: str) -> Callable[[str, str], float]:
    if name not in SCORERS:
        raise MatchingError(f"unknown scorer {name}", known=sorted(SCORERS)) from ValueError(name)
    return SCORERS[name]


def score(name: str, a: Column, b: Column) -> Column:
    """The score of two string columns, rounded through float as a column of doubles; null if either is null."""
    f = scorer(name)

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}  # of this batch: metadata values repeat
        for pair in set(zip(x, y, strict=True)):
            known[pair] = None if pair[0] is None or pair[1] is None else float(np.float32(f(*pair)))
        return pd.Series([known[pair] for pair in zip(x, y, strict=True)], dtype="float64")

    return run.asNondeterministic()(a, b)

"""The two sequence kernels Spark has no expression for, as Arrow-batched helpers.

Callers pass null for rows that need no work; a null row costs nothing here.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: When two different signature parts are alike.
FUZZY_RATIO = 0.6
FUZZY_LENGTH_GAP = 0.4
FUZZY_LETTERS = 0.3


def lcs_length(a, b) -> int:
    """Longest common subsequence with one machine word per 64 elements (bit-parallel rows), at any length.
    Equal beginnings and ends always belong to one, so only what lies between is compared."""
    a, b = list(a), list(b)
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    least -= head
    tail = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for i, y in enumerate(b):
        hit = row & where.get(y, 0)
        if hit:
            row = (row + hit) | (row ^ hit)
        # A sum is longer by a bit at most: what stands above the row is cut off now and then.
        if not i & 1023:
            row &= full
    return head + tail + len(a) - (row & full).bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)], dtype="Int32")


def lcs_similarity(a: Column, b: Column) -> Column:
    """LCS length over the longer length; both empty 1.0, one empty 0.0."""
    m, n = F.size(a), F.size(b)
    longest = F.greatest(m, n)
    work = (m > 0) & (n > 0) & (a != b)
    length = _lcs(F.when(work, a), F.when(work, b))
    return (
        F.when(longest == 0, 1.0)
        .when(F.least(m, n) == 0, 0.0)
        .when(a == b, 1.0)
        .otherwise(length / longest)
    )


def near_match_total(left: list[str], right: list[str], ratio) -> float:
    """Sum over `left` of the best ratio to a part of `right` that is alike in length and letters."""
    sized = sorted((len(x), x, frozenset(x)) for x in right)
    total = 0.0
    for p in left:
        letters, best = frozenset(p), 0.0
        for n, x, own in sized:
            longer = max(n, len(p))
            if longer and abs(n - len(p)) / longer <= FUZZY_LENGTH_GAP and len(letters & own) >= FUZZY_LETTERS * len(letters | own):
                found = ratio(p, x)
                if found >= FUZZY_RATIO:
                    best = max(best, found)
        total += best
    return total


@F.pandas_udf(T.DoubleType())
def near_matches(left: pd.Series, right: pd.Series) -> pd.Series:
    """`near_match_total` by Ratcliff-Obershelp ratios; each different pair of parts is scored once a batch."""
    seen: dict = {}

    def ratio(p, q):
        if (p, q) not in seen:
            matcher = SequenceMatcher(None, p, q)
            # Upper bounds first: most pairs cannot reach the ratio that counts.
            alike = matcher.real_quick_ratio() >= FUZZY_RATIO and matcher.quick_ratio() >= FUZZY_RATIO
            seen[p, q] = matcher.ratio() if alike else 0.0
        return seen[p, q]

    return pd.Series([None if x is None or y is None else near_match_total(x, y, ratio) for x, y in zip(left, right)], dtype="float64")

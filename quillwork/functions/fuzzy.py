"""Edit distances and ratios that Spark has no function for, vectorised."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no substring edited twice. What both begin or end with costs nothing."""
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    a, b, n = a[start:], b[start:], n - start
    end = 0
    while end < n and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def ratio(a: str, b: str) -> float:
    return 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_set(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    both = " ".join(sorted(x & y))
    left, right = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def partial(a: str, b: str) -> float:
    """100 if the shorter stands in the longer, 0 without a shared token, else the best window's ratio."""
    short, long = sorted((a.lower(), b.lower()), key=len)
    if short in long:
        return 100.0
    if not set(short.split()) & set(long.split()):
        return 0.0
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(token_set(x or "", y or ""), 2) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(partial(x or "", y or ""), 2) for x, y in zip(a, b, strict=True)], dtype="float64")

"""Name similarity, for which Spark has no expression."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Weight and greatest length of a common beginning.
PREFIX_WEIGHT, PREFIX_MOST = 0.1, 4


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity of two texts' characters, raised for a common beginning however similar they are; 1 if equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    mine: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, unused in zip(b, free) if not unused]
    m = len(mine)
    swapped = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    common = 0
    for x, y in zip(a[:PREFIX_MOST], b[:PREFIX_MOST]):
        if x != y:
            break
        common += 1
    return jaro + common * PREFIX_WEIGHT * (1 - jaro)


@F.arrow_udf(DoubleType())
def jaro_winkler_column(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaro-Winkler similarity of two columns; null if either is."""
    return pa.array([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

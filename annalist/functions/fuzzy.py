"""Similarity of names: longest common subsequence of their sorted words, from 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


@F.pandas_udf(T.DoubleType())
def token_sort_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)])

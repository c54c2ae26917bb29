"""Ratcliff-Obershelp similarity of two texts, Arrow-batched, for pairs that bounds have let through."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """The share of matched characters; 0 where an upper bound is below ``least`` already. Null is like an empty text."""
    a, b = a or "", b or ""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if least and 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q, least) for p, q in zip(x, y)])

    return run(a, b)


def lengths_allow(a: Column, b: Column, least: float) -> Column:
    """A sound bound on native columns: no pair that it drops can reach ``least``."""
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return 2 * shorter >= least * both

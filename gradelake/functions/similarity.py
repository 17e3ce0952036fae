"""Text similarity: the matching-blocks ratio, with a cheap bound in front."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions.coords import _c


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length of two strings; 0 when one is empty."""
    out = [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)]
    return pd.Series(out, index=a.index, dtype="float64")


@F.pandas_udf(T.BooleanType())
def _ratio_reaches(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    """ratio(a, b) >= limit; bounds are tried first and null inputs are False."""

    def test(x, y, t):
        if not x or not y:
            return False
        m = SequenceMatcher(None, x, y)
        return m.real_quick_ratio() >= t and m.quick_ratio() >= t and m.ratio() >= t

    return pd.Series([test(x, y, t) for x, y, t in zip(a, b, limit)], index=a.index, dtype="bool")


def at_least_similar(a, b, threshold: float) -> Column:
    """Whether two texts have a ratio of at least ``threshold``.

    Equal texts, empty texts and pairs whose lengths already rule the ratio out
    are settled in the JVM: the texts of those rows are not sent to Python.
    """
    x, y = _c(a), _c(b)
    la, lb = F.length(x), F.length(y)
    bound = F.least(la, lb) * 2.0 / (la + lb)
    open_ = (la > 0) & (lb > 0) & (x != y) & (bound >= threshold)
    exact = _ratio_reaches(F.when(open_, x), F.when(open_, y), F.lit(threshold))
    return F.when((la > 0) & (x == y), True).when(F.coalesce(open_, F.lit(False)), exact).otherwise(False)

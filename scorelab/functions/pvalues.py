"""Tail probabilities of result rows (one per model pair or group).

The functions sent to executors are closures, so workers need no copy of this
package.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.functions.numeric import col


def normal_two_sided(z: Column | str) -> Column:
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")

    return F.pandas_udf(tail, T.DoubleType())(col(z))


def chi_square_tail(x: Column | str, df: Column | str) -> Column:
    """Upper tail for a whole number of degrees of freedom, as a finite series."""

    def one(value: float, degrees: int) -> float:
        if value <= 0:
            return 1.0
        half = value / 2.0
        even = degrees % 2 == 0
        total = math.exp(-half) if even else math.erfc(math.sqrt(half))
        term = math.exp(-half) * (1.0 if even else 2.0 * math.sqrt(half / math.pi))
        first = 1.0 if even else 1.5
        steps = degrees // 2 - 1 if even else degrees // 2
        for i in range(steps):
            if even:
                term *= half / (first + i)
                total += term
            else:
                total += term
                term *= half / (first + i)
        return min(total, 1.0)

    def tail(values: pd.Series, degrees: pd.Series) -> pd.Series:
        out = [
            None if pd.isna(v) or pd.isna(k) else one(float(v), int(k)) for v, k in zip(values, degrees)
        ]
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(tail, T.DoubleType())(col(x), col(df))

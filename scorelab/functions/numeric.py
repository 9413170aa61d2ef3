"""Small column helpers; undefined values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least would skip it)."""
    low_c = low if isinstance(low, Column) else F.lit(float(low))
    high_c = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low_c), high_c))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days rounded towards minus infinity, also for negative spans."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.floor(micros / F.lit(86400e6)).cast("double")


def add_months(ts: Column, months: Column | int) -> Column:
    m = months if isinstance(months, Column) else F.lit(int(months))
    return ts + F.make_interval(F.lit(0), m)


def rounded(value: Column | str, digits: int = 9) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(value).cast("double"), digits) + F.lit(0.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation, computed from the nearer end as array libraries do."""
    return F.when(t >= 0.5, b - (b - a) * (1.0 - t)).otherwise(a + (b - a) * t)

"""Fixed-horizon labels with explicit censoring, and recoding of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.functions.numeric import add_months, floor_days, ratio

# Fixed values
DEFAULT_STATUSES = ["Defaulted", "Chargedoff"]
RESOLVED_GOOD_STATUSES = ["Completed", "FinalPaymentInProgress"]
CANCELLED = "Cancelled"
DAYS_PER_MONTH = 30.4375
DAYS_PER_YEAR = 365.25


def snapshot_of(loans: DataFrame) -> DataFrame:
    """One row: the latest origination or close date."""
    return loans.agg(F.greatest(F.max("orig"), F.max("closed")).alias("snapshot"))


def horizon_label(loans: DataFrame, horizon: int = 12, snapshot: Column | None = None) -> DataFrame:
    """Add ``y``: 1 default within the horizon, 0 known good, -1 censored.

    Needs orig, closed, status, cycle. Without ``snapshot`` the scalar is taken
    from the table itself (a scalar subquery over two columns).
    """
    if snapshot is None:
        snapshot = snapshot_of(loans).scalar()
    rows = loans.withColumn("snapshot", snapshot)
    observed = floor_days(F.col("snapshot"), F.col("orig")) / DAYS_PER_MONTH
    to_default = F.coalesce(F.col("cycle"), floor_days(F.col("closed"), F.col("orig")) / DAYS_PER_MONTH)
    is_default = F.coalesce(F.col("status").isin(DEFAULT_STATUSES), F.lit(False))
    unknown = is_default & (to_default.isNull() | (to_default < 0))
    positive = is_default & (to_default <= horizon)
    good = F.col("status").isin(RESOLVED_GOOD_STATUSES) | (observed >= horizon)
    cancelled = F.coalesce(F.col("status") == CANCELLED, F.lit(False))
    y = F.when(unknown, -1).when(positive, 1).when(good & ~cancelled, 0).otherwise(-1)
    return rows.withColumn("y", y)


def observable_by(orig: Column, horizon: int) -> Column:
    """The date by which a horizon label is known; month ends are clipped."""
    return add_months(orig, horizon)


def credit_history_years(orig: Column, first_line: Column) -> Column:
    return floor_days(orig, first_line) / DAYS_PER_YEAR


def recode_target(df: DataFrame, column: str, name: str = "y") -> DataFrame:
    """0/1 target from the coding that the data show.

    Text: bad, default or 1 are positive. Numbers {1, 2}: 2 is positive.
    Numbers {0, 1}: 0 is positive (good = 1). Anything else is an error.
    """
    c = F.col(column)
    if dict(df.dtypes)[column] == "string":
        return df.withColumn(name, F.coalesce(F.lower(c).isin("bad", "default", "1"), F.lit(False)).cast("int"))
    low_high = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(~c.isin(0, 1, 2)).alias("odd")).first()
    found = (low_high["lo"], low_high["hi"])
    if low_high["odd"] == 0 and found[0] is not None and found[0] >= 1:
        return df.withColumn(name, F.coalesce(c == 2, F.lit(False)).cast("int"))
    if low_high["odd"] == 0 and found[1] is not None and found[1] <= 1:
        return df.withColumn(name, F.coalesce(c == 0, F.lit(False)).cast("int"))
    raise ValueError(f"unsupported target coding in {column}: between {found[0]} and {found[1]}")


def imbalance_statistics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, class sizes, ratio (4 places) and minority share (2 places); code 0 counts as majority."""
    major, minor = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    n = F.count(F.lit(1))
    return df.groupBy(*(keys or [])).agg(
        n.alias("n_total"),
        major.alias("n_majority"),
        minor.alias("n_minority"),
        F.bround(ratio(major, minor), 4).alias("imbalance_ratio"),
        F.bround(ratio(minor, n) * 100.0, 2).alias("minority_pct"),
    )


def positive_class_weight(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n_neg / max(n_pos, 1) and the balanced weight of each class."""
    neg, pos = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    n = F.count(F.lit(1))
    return df.groupBy(*(keys or [])).agg(
        ratio(neg, F.greatest(pos, F.lit(1))).alias("positive_weight"),
        ratio(n, 2 * neg).alias("balanced_weight_0"),
        ratio(n, 2 * pos).alias("balanced_weight_1"),
    )

"""Partitions: rolling origin, stratified by hash, and month-disjoint forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.hashing import uniform
from scorelab.functions.numeric import add_months
from scorelab.operators.ordering import numbered
from scorelab.session import checked_broadcast


def _first_day(cutoff: str) -> str:
    return cutoff if len(cutoff) > 7 else f"{cutoff}-01"


def rolling_origin(cases: DataFrame, cutoffs: Sequence[str], window_months: int = 6) -> DataFrame:
    """Rows of every cutoff with part = train / test; a row may serve several cutoffs.

    train: observable_by <= cutoff; test: cutoff <= orig < cutoff + window. The
    cutoffs are parameters, so they travel as an array and no join is needed.
    """
    points = F.array(
        *[
            F.struct(
                F.lit(c).alias("cutoff"),
                F.to_timestamp(F.lit(_first_day(c))).alias("at"),
            )
            for c in cutoffs
        ]
    )
    orig, known = F.col("orig"), F.col("observable_by")

    def part_of(x):
        return F.when(known <= x["at"], F.lit("train")).when(
            (orig >= x["at"]) & (orig < add_months(x["at"], window_months)), F.lit("test")
        )

    tagged = F.filter(
        F.transform(
            points,
            lambda x: F.struct(x["cutoff"].alias("cutoff"), x["at"].alias("cutoff_at"), part_of(x).alias("part")),
        ),
        lambda x: x["part"].isNotNull(),
    )
    return cases.withColumn("_s", F.explode(tagged)).select(*cases.columns, "_s.*")


def split_guards(
    splits: DataFrame, cutoffs: Sequence[str], snapshot: DataFrame, horizon: int, window_months: int = 6
) -> DataFrame:
    """Per cutoff asked for: part sizes and why the cutoff is unusable, if it is; one without rows shows too."""
    asked = splits.sparkSession.createDataFrame([(c, _first_day(c)) for c in cutoffs], "cutoff string, _day string")
    counts = splits.groupBy("cutoff").agg(
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
    )
    none = F.lit(0).cast("long")
    sizes = asked.join(counts, "cutoff", "left").select(
        "cutoff", F.to_timestamp("_day").alias("cutoff_at"),
        F.coalesce("n_train", none).alias("n_train"), F.coalesce("n_test", none).alias("n_test"),
    )
    end = add_months(F.col("cutoff_at"), window_months)
    late = add_months(end, horizon) > F.col("snapshot")
    problem = (
        F.when((F.col("n_train") == 0) | (F.col("n_test") == 0), F.lit("empty_part"))
        .when(late, F.lit("test_labels_not_observable"))
        .otherwise(F.lit("ok"))
    )
    return sizes.withColumn("snapshot", snapshot.scalar()).select(
        "cutoff", "n_train", "n_test", problem.alias("status")
    )


def require_usable(guards: DataFrame) -> None:
    bad = [f"{g['cutoff']}: {g['status']}" for g in guards.where(F.col("status") != "ok").collect()]
    if bad:
        raise ValueError("unusable cutoffs: " + "; ".join(bad))


def split_summary(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes, default rates and origination ranges of each part."""
    return splits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("default_rate"),
        F.date_format(F.min("orig"), "yyyy-MM-dd").alias("first_orig"),
        F.date_format(F.max("orig"), "yyyy-MM-dd").alias("last_orig"),
    )


def _hash_rank(cases: DataFrame, keys: Sequence[str], seed: int, row_id: str, method: str) -> DataFrame:
    slim = cases.select(*keys, "y", row_id).withColumn("_u", uniform(seed, row_id, method=method))
    return numbered(slim, [*keys, "y"], ["_u", row_id], "_rn")


def stratified_split(
    cases: DataFrame,
    fraction: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] = (),
    row_id: str = "row_id",
    method: str = "md5",
) -> DataFrame:
    """Exact split per label: the round(n * fraction) rows with the lowest hash are ``test``."""
    ranked = _hash_rank(cases, keys, seed, row_id, method)
    test = F.col("_rn") <= F.round(F.col("_rn_total") * F.lit(fraction))
    return ranked.select(
        *keys, row_id, "y", F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("part")
    )


def stratified_folds(
    cases: DataFrame,
    k: int = 5,
    seed: int = 42,
    keys: Sequence[str] = (),
    row_id: str = "row_id",
    method: str = "md5",
) -> DataFrame:
    """Shuffled k-fold numbers 0..k-1, balanced inside each label."""
    ranked = _hash_rank(cases, keys, seed, row_id, method)
    return ranked.select(*keys, row_id, "y", ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def early_stopping_slice(
    cases: DataFrame,
    fraction: float = 0.1,
    seed: int = 42,
    row_id: str = "row_id",
    method: str = "md5",
    min_rows: int = 50,
    min_per_class: int = 5,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mark ``is_stop`` rows of a fit; ``has_slice`` says whether a slice was made at all.

    A fit with fewer than ``min_rows`` rows, or ``min_per_class`` of a class, is not
    sliced: no row is marked and ``has_slice`` is false.
    """
    keys = list(keys)
    # one row per fit, and a fit per value of ``keys``
    sizes = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")
    ).collect()
    large = [r for r in sizes if fraction > 0 and r["n"] >= min_rows and min(r["a"], r["b"]) >= min_per_class]
    if not large:
        return cases.select(*keys, row_id, "y", F.lit(False).alias("is_stop"), F.lit(False).alias("has_slice"))
    parts = stratified_split(cases, fraction, seed, keys, row_id, method)
    has = F.lit(True) if len(large) == len(sizes) else reduce(
        lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(r[k]) for k in keys]) for r in large]
    )
    return parts.select(*keys, row_id, "y", (has & (F.col("part") == "test")).alias("is_stop"), has.alias("has_slice"))


def exact_sample(cases: DataFrame, n: int, seed: int, row_id: str = "row_id", method: str = "md5") -> DataFrame:
    """The n rows with the lowest hash: a sampling operator of fixed size n (a parameter)."""
    return cases.orderBy(uniform(seed, row_id, method=method), row_id).limit(n)


def _month_start(ts):
    return F.date_trunc("month", ts)


def forward_folds(
    cases: DataFrame, k: int = 3, min_per_class: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """Month-disjoint forward folds; a training label must be known at the block's start.

    Result: keys, fold (1..k), month, boundary: the validation months of each fold
    with the first moment of the block. Everything after the first aggregate works
    on one row per month.
    """
    keys = list(keys)
    rows = cases.select(
        *keys,
        "y",
        _month_start(F.col("orig")).alias("month"),
        available_from().alias("avail"),
    )
    per_month = rows.groupBy(*keys, "month", "avail").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    present = per_month.where(F.col("month").isNotNull()).select(*keys, "month").distinct()
    matured = per_month.where(F.col("avail").isNotNull()).groupBy(*keys, F.col("avail").alias("month")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    timeline = (
        present.withColumn("is_month", F.lit(1))
        .unionByName(matured, allowMissingColumns=True)
        .groupBy(*keys, "month")
        .agg(F.max("is_month").alias("is_month"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    upto = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    months = (
        timeline.withColumns({"c0": F.sum("n0").over(upto), "c1": F.sum("n1").over(upto)})
        .where(F.col("is_month") == 1)
        .withColumns(
            {
                "idx": F.row_number().over(whole.orderBy("month")) - 1,
                "n_months": F.count(F.lit(1)).over(whole),
            }
        )
    )
    first = F.greatest(F.lit(1), F.floor(F.col("n_months") / (k + 1)))
    ready = (F.col("idx") >= first) & (F.least(F.coalesce("c0", F.lit(0)), F.coalesce("c1", F.lit(0))) >= min_per_class)
    started = months.withColumn("start", F.min(F.when(ready, F.col("idx"))).over(whole)).where(
        F.col("idx") >= F.col("start")
    )
    blocks = started.withColumn("fold", F.ntile(k).over(whole.orderBy("month")))
    return blocks.select(
        *keys,
        "fold",
        "month",
        F.min("month").over(Window.partitionBy(*keys, "fold")).alias("boundary"),
        (F.col("n_months") - F.col("start")).alias("n_used"),
    )


def available_from():
    """First month start at which a row may train: orig < B and observable_by <= B.

    NULL, so never, when either date is unknown (``greatest`` alone would skip it).
    """
    after_orig = add_months(_month_start(F.col("orig")), 1)
    floor = _month_start(F.col("observable_by"))
    known = F.when(floor == F.col("observable_by"), floor).otherwise(add_months(floor, 1))
    return F.when(after_orig.isNotNull() & known.isNotNull(), F.greatest(after_orig, known))


def forward_membership(
    cases: DataFrame, folds: DataFrame, keys: Sequence[str] = (), row_id: str = "row_id"
) -> DataFrame:
    """(fold, row_id, part) for all folds; rows meet folds by equality on month numbers only."""
    keys = list(keys)
    folds = checked_broadcast(folds.select(*keys, "fold", "month", "boundary"))
    rows = cases.select(
        *keys, row_id, "y", _month_start(F.col("orig")).alias("month"), available_from().alias("avail")
    )
    validation = rows.join(folds.select(*keys, "fold", "month"), [*keys, "month"]).select(
        *keys, "fold", row_id, "y", F.lit("validation").alias("part")
    )
    # months x folds, a table as small as the calendar
    bounds = folds.select(*keys, "fold", "boundary").distinct()
    calendar = rows.select(*keys, "avail").distinct()
    same = [F.col(f"c.{x}") == F.col(f"b.{x}") for x in keys]
    known = reduce(lambda a, b: a & b, same, F.col("c.avail") <= F.col("b.boundary"))
    reach = calendar.alias("c").join(bounds.alias("b"), known).select(
        *[F.col(f"c.{x}") for x in keys], "c.avail", "b.fold"
    )
    train = rows.join(checked_broadcast(reach), [*keys, "avail"]).select(*keys, "fold", row_id, "y", F.lit("train").alias("part"))
    return train.unionByName(validation)


def require_dates(cases: DataFrame) -> None:
    """Fail when a case has no origination or no observation date."""
    missing = cases.where(F.col("orig").isNull() | F.col("observable_by").isNull()).count()
    if missing:
        raise ValueError(f"{missing} cases without origination or observation date")


def require_forward_folds(membership: DataFrame, folds: DataFrame, k: int) -> None:
    """Fail when there are fewer than two folds, months are too few or a validation block has one class."""
    if k < 2:
        raise ValueError("forward folds need k >= 2")
    used = folds.agg(F.min("n_used").alias("n"), F.countDistinct("fold").alias("k")).first()
    if used["n"] is None or used["n"] < k or used["k"] < k:
        raise ValueError("too few months with observable training labels")
    one_class = (
        membership.where(F.col("part") == "validation")
        .groupBy("fold")
        .agg(F.countDistinct("y").alias("c"))
        .where(F.col("c") < 2)
        .count()
    )
    if one_class:
        raise ValueError("a validation block has fewer than two classes")

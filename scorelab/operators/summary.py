"""Summaries across runs, selection of winners, and repair of saved report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOOTSTRAP_SCOPE = "conditional_on_fitted_models_and_selected_thresholds"


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenate keyed tables; columns that a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def metric_summary(metrics: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean, sample std and run count per key, rounded half-even."""
    aggregates = []
    for m in names:
        c = F.col(f"`{m}`")
        aggregates += [
            F.bround(F.avg(c), digits).alias(f"{m}_mean"),
            F.bround(F.stddev_samp(c), digits).alias(f"{m}_std"),
        ]
    return metrics.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("n_runs"))


def compatible_runs(
    saved: DataFrame, current: DataFrame, settings: Sequence[str], reference: str, run_id: str = "run_id"
) -> DataFrame:
    """Current runs plus the saved ones that share every setting with ``reference``.

    NULL settings compare as equal; a current run replaces its saved version.
    """
    ref = current.where(F.col(run_id) == reference).select(*[F.col(s).alias(f"_ref_{s}") for s in settings])
    same = reduce(
        lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_ref_{s}")) for s in settings]
    )
    kept = saved.join(ref, same, "left_semi").join(current.select(run_id), run_id, "left_anti")
    return current.unionByName(kept, allowMissingColumns=True)


def still_to_fit(recipes: DataFrame, scores: DataFrame, key: str = "recipe") -> DataFrame:
    """Distinct recipes that have no saved out-of-fold scores."""
    return recipes.dropDuplicates([key]).join(scores.select(key).distinct(), key, "left_anti")


def recipe_key(columns: Sequence[str]):
    """A staleness key from everything that decides a fit."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def best_by_metric(
    rows: DataFrame, keys: Sequence[str], choice: str, metric: str, preference: Sequence[str]
) -> DataFrame:
    """The choice with the largest metric per key; the earlier one in ``preference`` wins ties."""
    place = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(choice))
    best = F.max(F.struct(F.col(metric).alias("m"), (-place).alias("o"), F.col(choice).alias("c"))).alias("b")
    scored = rows.where(F.col(metric).isNotNull() & (place > 0))
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.c").alias(choice), F.col("b.m").alias(metric))


def with_fidelity(quality: DataFrame, fidelity: DataFrame, row_id: str = "row_id") -> DataFrame:
    return quality.join(fidelity, row_id, "left")


def repair_agreement(
    quality: DataFrame, absolute: str = "abs_rank_rho", signed: str = "signed_rank_rho"
) -> DataFrame:
    """The absolute agreement column takes the signed values."""
    if signed not in quality.columns:
        raise ValueError(f"cannot recover signed agreement: no column {signed}")
    return quality.withColumn(absolute, F.col(signed))


def repaired_count(quality: DataFrame, signed: str = "signed_rank_rho") -> DataFrame:
    return quality.agg(F.count_if(F.col(signed) < 0).alias("rows_changed"), F.count(F.lit(1)).alias("rows"))


def tag_bootstrap(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("inference_scope", F.lit(BOOTSTRAP_SCOPE))

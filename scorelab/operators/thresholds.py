"""Decision thresholds from one histogram instead of one pass per grid point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.functions.grids import SWEEP, TUNING, Grid
from scorelab.functions.numeric import TINY
from scorelab.operators.metrics import confusion_columns

CRITERIA = ("f1", "g_mean", "youden", "cost")


def grid_confusion(scores: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """TP, FP, FN, TN per key and grid point: keys, i, threshold, counts.

    ``scores`` holds single rows (y) or class counts per score (pos, neg). Rows
    shrink to (grid.size + 1) slots per key before anything is expanded, so the
    expansion is bounded by the grid, not by the data.
    """
    keys = list(keys)
    counted = "pos" in scores.columns
    pos, neg = (F.col("pos"), F.col("neg")) if counted else (F.col("y"), 1 - F.col("y"))
    slots = (
        scores.withColumn("_slot", grid.slot(F.col("p")))
        .groupBy(*keys, "_slot")
        .agg(F.sum(pos).cast("long").alias("_pos"), F.sum(neg).cast("long").alias("_neg"))
    )
    over = F.col("_slot") > F.col("i")
    points = slots.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid.size - 1))))
    return (
        points.groupBy(*keys, "i")
        .agg(
            F.sum(F.when(over, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(over, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(over, 0).otherwise(F.col("_pos"))).alias("fn"),
            F.sum(F.when(over, 0).otherwise(F.col("_neg"))).alias("tn"),
        )
        .withColumn("threshold", grid.point(F.col("i")))
    )


def threshold_scores(points: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0) -> DataFrame:
    """Add the value of each criterion at each grid point (0 if one class only)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tiny = F.lit(TINY)
    sens = tp / (tp + fn + tiny)
    spec = tn / (tn + fp + tiny)
    prec = tp / (tp + fp + tiny)
    single = (tp + fp + fn == 0) | (tn + fp + fn == 0)
    values = {
        "f1": 2.0 * prec * sens / (prec + sens + tiny),
        "g_mean": F.sqrt(sens * spec),
        "youden": sens + spec - 1.0,
        "cost": (tp - cost_fp * fp - cost_fn * fn) / (tp + fp + fn + tn),
    }
    return points.withColumns({k: F.when(single, 0.0).otherwise(v) for k, v in values.items()})


def optimal_thresholds(
    scores: DataFrame,
    keys: Sequence[str],
    criteria: Sequence[str] = CRITERIA,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    grid: Grid = TUNING,
) -> DataFrame:
    """Best grid threshold per key and criterion; the first maximum wins."""
    unknown = set(criteria) - set(CRITERIA)
    if unknown:
        raise ValueError(f"unknown criterion {sorted(unknown)}")
    scored = threshold_scores(grid_confusion(scores, keys, grid), cost_fp, cost_fn)
    best = [
        F.max(F.struct(F.col(c).alias("score"), (-F.col("i")).alias("rank"), F.col("threshold"))).alias(c)
        for c in criteria
    ]
    wide = scored.groupBy(*keys).agg(*best)
    return wide.unpivot(list(keys), list(criteria), "criterion", "b").select(
        *keys, "criterion", F.col("b.threshold").alias("threshold"), F.col("b.score").alias("score")
    )


def threshold_sweep(scores: DataFrame, keys: Sequence[str], grid: Grid = SWEEP) -> DataFrame:
    """F1, G-Mean, precision and recall along the grid; the best F1 is flagged."""
    from pyspark.sql.window import Window

    points = grid_confusion(scores, keys, grid)
    cells = confusion_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    wanted = {k: cells[k] for k in ("F1", "G-Mean", "Precision", "Recall")}
    rows = points.withColumns(wanted)
    top = F.first("i").over(Window.partitionBy(*keys).orderBy(F.desc("F1"), "i"))
    return rows.withColumn("best_f1", F.col("i") == top).select(
        *keys, "i", "threshold", *wanted, "best_f1"
    )


def nearest_grid_row(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the row of a threshold table closest to ``target``; the lower one wins ties."""
    payload = [c for c in rows.columns if c not in keys]
    gap = F.abs(F.col("threshold") - F.col("target"))
    return (
        rows.join(targets.select(*keys, "target"), list(keys))
        .groupBy(*keys, "target")
        .agg(F.min(F.struct(gap.alias("gap"), F.col("threshold").alias("_t"), F.struct(*payload).alias("row"))).alias("b"))
        .select(*keys, "target", "b.row.*")
    )

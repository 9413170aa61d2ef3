"""Classification metrics for every (run, model, ...) key of a scores table at once.

A scores table has key columns, ``row_id``, ``y`` (0/1) and ``p`` in [0, 1]. Rows
are first reduced to distinct scores with class counts; everything after that
works on the reduced table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.functions.numeric import TINY, ratio, ratio_or_zero
from scorelab.operators.ordering import prefix_sums
from scorelab.session import checked_broadcast

METRICS = ["AUROC", "AUPRC", "F1", "Precision", "Recall", "Specificity", "G-Mean", "MCC", "Brier"]
COUNTS = ["TP", "FP", "FN", "TN"]


def usable_score(p: Column) -> Column:
    """The score; a missing one or one that is no number fails the job instead of taking a side."""
    return F.when(p.isNull() | F.isnan(p), F.raise_error(F.lit("a score is missing or not a number"))).otherwise(p)


def score_counts(scores: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Class counts per distinct score: keys, p, pos, neg."""
    w = F.col(weight) if weight else F.lit(1)
    return scores.withColumn("p", usable_score(F.col("p"))).groupBy(*keys, "p").agg(
        F.sum(F.col("y") * w).cast("long").alias("pos"),
        F.sum((1 - F.col("y")) * w).cast("long").alias("neg"),
    )


def score_curve(scores: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct scores with the class counts strictly below and in total."""
    counts = score_counts(scores, keys, weight)
    return prefix_sums(counts, keys, ["p"], {"pos": "pos", "neg": "neg"})


def _rank_sums() -> list[Column]:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = (F.col("pos_total") - F.col("pos_before")).cast("double")
    fp = (F.col("neg_total") - F.col("neg_before")).cast("double")
    won = pos * (F.col("neg_before") + 0.5 * neg)
    return [
        F.sum(ratio(won, F.col("pos_total").cast("double") * F.col("neg_total"))).alias("AUROC"),
        F.sum(ratio(pos, F.col("pos_total")) * ratio(tp, tp + fp)).alias("AUPRC"),
    ]


def ranking_metrics(scores: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """AUROC (ties count one half) and step-wise average precision."""
    return score_curve(scores, keys, weight).groupBy(*keys).agg(*_rank_sums())


def _positive_part(side: str, threshold: Column) -> Column:
    return F.sum(F.when(F.col("p") >= threshold, F.col(side)).otherwise(0)).alias(f"_{side}_over")


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Threshold metrics from the four counts.

    Recall and specificity carry 1e-10 in the denominator; precision and F1 fall
    back to 0. When only one class shows in labels and decisions together the
    counts and the rates built on them are 0.
    """
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    single = (tp + fp + fn == 0) | (tn + fp + fn == 0)

    def kept(c: Column) -> Column:
        return F.when(single, F.lit(0.0)).otherwise(c)

    recall = kept(tp) / (kept(tp) + kept(fn) + F.lit(TINY))
    specificity = kept(tn) / (kept(tn) + kept(fp) + F.lit(TINY))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "F1": ratio_or_zero(2.0 * tp, 2.0 * tp + fp + fn),
        "Precision": ratio_or_zero(tp, tp + fp),
        "Recall": recall,
        "Specificity": specificity,
        "G-Mean": F.sqrt(recall * specificity),
        "MCC": ratio_or_zero(tp * tn - fp * fn, spread),
        "TP": kept(tp).cast("long"),
        "FP": kept(fp).cast("long"),
        "FN": kept(fn).cast("long"),
        "TN": kept(tn).cast("long"),
    }


def confusion(scores: DataFrame, keys: Sequence[str], threshold: Column | float = 0.5) -> DataFrame:
    """TP, FP, FN, TN at ``p >= threshold`` (a number or a column of the scores)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = usable_score(F.col("p").cast("double")) >= t
    y = F.col("y") == 1
    return scores.groupBy(*keys).agg(
        F.count_if(hit & y).alias("TP"),
        F.count_if(hit & ~y).alias("FP"),
        F.count_if(~hit & y).alias("FN"),
        F.count_if(~hit & ~y).alias("TN"),
    )


def metric_rows(
    scores: DataFrame,
    keys: Sequence[str],
    thresholds: DataFrame | float = 0.5,
    weight: str | None = None,
) -> DataFrame:
    """The full metric row per key from one pass over the distinct scores.

    ``thresholds`` is a number or a table of (some of the keys, threshold).
    """
    curve = score_curve(scores, keys, weight)
    if isinstance(thresholds, DataFrame):
        on = [k for k in keys if k in thresholds.columns]
        cuts = checked_broadcast(thresholds.select(*on, "threshold"))
        curve = curve.join(cuts, on) if on else curve.withColumn("threshold", cuts.select("threshold").scalar())
    else:
        curve = curve.withColumn("threshold", F.lit(float(thresholds)))
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    sums = curve.groupBy(*keys).agg(
        *_rank_sums(),
        F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p).alias("_sq"),
        F.max("pos_total").alias("_P"),
        F.max("neg_total").alias("_N"),
        _positive_part("pos", F.col("threshold")),
        _positive_part("neg", F.col("threshold")),
        F.max("threshold").alias("threshold"),
    )
    tp, fp = F.col("_pos_over"), F.col("_neg_over")
    cells = confusion_columns(tp, fp, F.col("_P") - tp, F.col("_N") - fp)
    row = sums.withColumns(cells).withColumn("Brier", ratio(F.col("_sq"), F.col("_P") + F.col("_N")))
    return row.select(*keys, *METRICS, *COUNTS, "threshold")


def long_metrics(rows: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    return rows.unpivot(
        list(keys), [F.col(f"`{n}`") for n in names], "metric", "value"
    )


def results_table(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide table with the published columns, rounded half-even to 4 places."""
    wide = long.groupBy(*keys).pivot("metric", METRICS).agg(F.first("value"))
    return wide.select(*keys, *[F.bround(F.col(f"`{m}`"), 4).alias(m) for m in METRICS])


def roc_points(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ROC point per distinct threshold (highest first in meaning, unordered rows)."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return score_curve(scores, keys).select(
        *keys,
        F.col("p").alias("threshold"),
        ratio(fp, F.col("neg_total")).alias("fpr"),
        ratio(tp, F.col("pos_total")).alias("tpr"),
    )


def pr_points(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall per distinct threshold with the prevalence baseline."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return score_curve(scores, keys).select(
        *keys,
        F.col("p").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("pos_total")).alias("recall"),
        ratio(F.col("pos_total"), F.col("pos_total") + F.col("neg_total")).alias("prevalence"),
    )


def normalised_confusion(scores: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Long confusion matrix with each actual class scaled to 1."""
    c = confusion(scores, keys, threshold)
    cell = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("n"),
                     F.col(r).alias("r"))
            for a, b, n, r in ((0, 0, "TN", "_n"), (0, 1, "FP", "_n"), (1, 0, "FN", "_p"), (1, 1, "TP", "_p"))
        ]
    )
    rows = c.withColumns({"_n": F.col("TN") + F.col("FP"), "_p": F.col("FN") + F.col("TP")})
    return rows.select(*keys, F.explode(cell).alias("c")).select(
        *keys, "c.actual", "c.predicted", "c.n", ratio(F.col("c.n"), F.col("c.r")).alias("share")
    )


def class_distribution(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and percentage of each class in each key."""
    from pyspark.sql.window import Window

    counts = labelled.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", ratio(F.col("n"), total) * 100.0)


def representative_cases(
    scores: DataFrame, keys: Sequence[str], threshold: float = 0.5, order: str = "row_id"
) -> DataFrame:
    """For TP, FP, FN and TN the row nearest p = 0.5; the first in ``order`` wins ties."""
    hit = F.col("p") >= F.lit(threshold)
    cell = (
        F.when(hit & (F.col("y") == 1), "TP").when(hit, "FP").when(F.col("y") == 1, "FN").otherwise("TN")
    )
    nearest = F.min(F.struct(F.abs(F.col("p") - 0.5).alias("gap"), F.col(order), F.col("p"))).alias("b")
    return (
        scores.withColumn("cell", cell)
        .groupBy(*keys, "cell")
        .agg(nearest)
        .select(*keys, "cell", F.col(f"b.{order}").alias(order), F.col("b.p").alias("p"))
    )

"""Group rates, utility trade-offs and group-threshold policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.grids import FAIRNESS, Grid
from scorelab.functions.numeric import clip, ratio
from scorelab.operators.metrics import confusion_columns
from scorelab.operators.ordering import prefix_sums, weighted_quantiles
from scorelab.operators.thresholds import grid_confusion, optimal_thresholds
from scorelab.session import checked_broadcast, materialised

MISSING = "__MISSING__"
EVERYONE = "__all__"
RATES = ("selection", "tpr", "fpr")


def melt_groups(
    df: DataFrame, groups: Sequence[str], missing: str | None = None, everyone: bool = False
) -> DataFrame:
    """One row per group column: group_column, level. NULL levels drop out unless named.

    ``everyone`` adds a pseudo column holding all rows, so totals share the pass.
    """
    entries = [
        F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("level")) for g in groups
    ]
    if missing is not None:
        entries = [
            F.struct(F.lit(g).alias("group_column"), F.coalesce(F.col(g).cast("string"), F.lit(missing)).alias("level"))
            for g in groups
        ]
    if everyone:
        entries.append(F.struct(F.lit(EVERYONE).alias("group_column"), F.lit(EVERYONE).alias("level")))
    long = df.withColumn("_g", F.explode(F.array(*entries)))
    rest = [c for c in df.columns if c not in groups]
    return long.select(*rest, "_g.*").where(F.col("level").isNotNull())


def rate_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "selection": ratio(tp + fp, tp + fp + fn + tn),
        "tpr": ratio(tp, tp + fn),
        "fpr": ratio(fp, fp + tn),
    }


def group_rates(
    scores: DataFrame, keys: Sequence[str], groups: Sequence[str], threshold: Column | float = 0.5
) -> DataFrame:
    """Selection rate, TPR and FPR per group level; undefined rates are NULL."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col("p") >= t
    y = F.col("y") == 1
    long = melt_groups(scores.withColumns({"_hit": hit}), groups)
    cells = long.groupBy(*keys, "group_column", "level").agg(
        F.count_if(F.col("_hit") & y).alias("tp"),
        F.count_if(F.col("_hit") & ~y).alias("fp"),
        F.count_if(~F.col("_hit") & y).alias("fn"),
        F.count_if(~F.col("_hit") & ~y).alias("tn"),
    )
    rates = rate_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return cells.withColumns(rates).select(
        *keys, "group_column", "level", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), *RATES
    )


def _gap(rate: str) -> Column:
    spread = F.max(rate) - F.min(rate)
    return F.when(F.count(rate) >= 2, spread).alias(f"{rate}_gap")


def rate_gaps(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group column the gap of each rate over at least two defined levels, and the largest."""
    gaps = rates.groupBy(*keys, "group_column").agg(*[_gap(x) for x in RATES])
    return gaps.withColumn("max_gap", F.greatest(*[f"{x}_gap" for x in RATES]))


def fairness_curve(
    scores: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    grid: Grid = FAIRNESS,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    benefit_tp: float = 1.0,
    benefit_tn: float = 0.0,
) -> DataFrame:
    """Utility, metrics and group gaps along a threshold grid, with the Pareto flag.

    One histogram per (key, group level) serves all thresholds.
    """
    keys = list(keys)
    long = melt_groups(scores.select(*keys, "y", "p", *groups), groups, everyone=True)
    points = materialised(grid_confusion(long, [*keys, "group_column", "level"], grid))
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    gaps = rate_gaps(
        points.where(F.col("group_column") != EVERYONE).withColumns(rate_columns(*cells)), [*keys, "i"]
    )
    wide = gaps.groupBy(*keys, "i").agg(
        *[
            F.max(F.when(F.col("group_column") == g, F.col(f"{x}_gap"))).alias(f"{g}_{x}_gap")
            for g in groups
            for x in RATES
        ],
        F.max("max_gap").alias("max_group_gap"),
    )
    tp, fp, fn, tn = cells
    utility = (benefit_tp * tp + benefit_tn * tn - cost_fp * fp - cost_fn * fn) / (tp + fp + fn + tn)
    overall = points.where(F.col("group_column") == EVERYONE).select(
        *keys, "i", "threshold", utility.alias("expected_utility"),
        *[c.alias(n) for n, c in confusion_columns(*cells).items()],
    )
    return pareto_flags(overall.join(wide, [*keys, "i"], "left"), [*keys], "i")


def pareto_flags(
    curve: DataFrame, keys: Sequence[str], point: str, utility: str = "expected_utility", gap: str = "max_group_gap"
) -> DataFrame:
    """Flag points that no other point of the key beats; a NULL gap neither beats nor is beaten.

    A key holds one row per grid point.
    """
    keys = list(keys)
    a, b = curve.select(*keys, point, utility, gap).alias("a"), curve.alias("b")
    beats = (
        (F.col(f"a.{utility}") >= F.col(f"b.{utility}"))
        & (F.col(f"a.{gap}") <= F.col(f"b.{gap}"))
        & ((F.col(f"a.{utility}") > F.col(f"b.{utility}")) | (F.col(f"a.{gap}") < F.col(f"b.{gap}")))
    )
    for k in keys:
        beats = (F.col(f"a.{k}") == F.col(f"b.{k}")) & beats
    beaten = b.join(a, beats, "left_semi").select(*keys, point, F.lit(False).alias("_opt"))
    flag = F.coalesce(F.col("_opt"), F.lit(True)).alias("pareto_optimal")
    return curve.join(beaten, [*keys, point], "left").select(*curve.columns, flag)


def fit_equal_opportunity(
    scores: DataFrame,
    keys: Sequence[str],
    group: str,
    max_tpr_gap: float = 0.10,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    candidates: int = 201,
    targets: int = 101,
) -> tuple[DataFrame, DataFrame]:
    """Group thresholds with similar TPRs, chosen on training-side scores only.

    Returns (policy, thresholds): one row per key with status, target, gap,
    utility and fallback; and keys, level, threshold.

    Candidate thresholds are merged into the sorted distinct scores as empty
    rows, so one cumulative sum gives the counts at all of them.
    """
    keys = list(keys)
    by_level = [*keys, "level"]
    rows = scores.select(*keys, "y", "p", F.coalesce(F.col(group).cast("string"), F.lit(MISSING)).alias("level"))
    counts = materialised(
        rows.groupBy(*by_level, "p").agg(
            F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg")
        )
    )
    fallback = materialised(
        optimal_thresholds(counts, keys, ["f1"], cost_fp, cost_fn).select(*keys, F.col("threshold").alias("fallback"))
    )
    step = 1.0 / (max(2, candidates) - 1)
    probs = [i * step for i in range(max(2, candidates) - 1)] + [1.0]
    sized = counts.withColumn("_n", F.col("pos") + F.col("neg"))
    quantiles = weighted_quantiles(sized, by_level, "p", {"all": "_n"}, probs).select(
        *by_level, F.col("value").alias("p")
    )
    levels = counts.select(*by_level).distinct()
    ends = levels.withColumn("p", F.explode(F.array(F.lit(-1e-12), F.lit(1.0 + 1e-12))))
    none = F.lit(0).cast("long")
    cuts = quantiles.unionByName(ends).select(
        *by_level, "p", none.alias("pos"), none.alias("neg"), F.lit(1).alias("cand"), F.lit(0).alias("fall")
    )
    falls = levels.join(fallback, keys).select(
        *by_level, F.col("fallback").alias("p"), none.alias("pos"), none.alias("neg"), F.lit(0).alias("cand"), F.lit(1).alias("fall")
    )
    merged = (
        counts.withColumns({"cand": F.lit(0), "fall": F.lit(0)})
        .unionByName(cuts)
        .unionByName(falls)
        .groupBy(*by_level, "p")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("cand").alias("cand"), F.max("fall").alias("fall"))
    )
    cumulative = prefix_sums(merged, by_level, ["p"], {"pos": "pos", "neg": "neg"})
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    n = F.col("pos_total") + F.col("neg_total")
    marked = materialised(
        cumulative.where((F.col("cand") == 1) | (F.col("fall") == 1)).select(
            *by_level, "cand", "fall", F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
            F.col("pos_total").alias("np"), F.col("neg_total").alias("nn"),
            ratio(tp, F.col("pos_total")).alias("tpr"),
            ratio(tp - cost_fp * fp - cost_fn * (F.col("pos_total") - tp), n).alias("utility"),
        )
    )
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    usable = marked.where(both & (F.col("cand") == 1))
    skipped = marked.where(~both & (F.col("fall") == 1))
    width = 1.0 / (targets - 1)
    # at most (candidates + 2) x targets rows per level
    chosen = materialised(
        usable.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(targets - 1))))
        .withColumn("target", F.col("i") * F.lit(width))
        .groupBy(*by_level, "i", "target")
        .agg(
            F.min(
                F.struct(
                    F.abs(F.col("tpr") - F.col("target")).alias("miss"), (-F.col("utility")).alias("nu"),
                    (-F.col("threshold")).alias("nt"), "tpr", "tp", "fp", "np", "nn",
                )
            ).alias("b")
        )
        .select(*by_level, "i", "target", (-F.col("b.nt")).alias("threshold"), "b.tpr", "b.tp", "b.fp", "b.np", "b.nn")
    )
    rest = skipped.groupBy(*keys).agg(
        F.sum("tp").alias("r_tp"), F.sum("fp").alias("r_fp"), F.sum("np").alias("r_np"), F.sum("nn").alias("r_nn"),
        F.count(F.lit(1)).alias("r_levels"),
    )
    per_target = chosen.groupBy(*keys, "i", "target").agg(
        (F.max("tpr") - F.min("tpr")).alias("gap"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "np", "nn")],
        F.count(F.lit(1)).alias("levels"),
    ).join(rest, keys, "left")

    def total(c: str) -> Column:
        return F.col(c) + F.coalesce(F.col(f"r_{c}"), F.lit(0))

    utility = ratio(
        total("tp") - cost_fp * total("fp") - cost_fn * (total("np") - total("tp")), total("np") + total("nn")
    )
    feasible = F.col("gap") <= max_tpr_gap
    judged = per_target.withColumns({"utility": utility, "feasible": feasible})
    first = F.when(F.col("feasible"), F.col("utility")).otherwise(-F.col("gap"))
    second = F.when(F.col("feasible"), -F.col("gap")).otherwise(F.col("utility"))
    best = judged.groupBy(*keys).agg(
        F.max(
            F.struct(
                "feasible", first.alias("a"), second.alias("b"), (-F.col("i")).alias("ni"),
                "target", "gap", "utility", "levels", F.coalesce("r_levels", F.lit(0)).alias("skipped"),
            )
        ).alias("w")
    )
    ok = F.coalesce(F.col("w.levels") >= 2, F.lit(False))
    policy = fallback.join(best, keys, "left").select(
        *keys,
        F.when(ok, "fit").otherwise("insufficient_groups_with_both_classes").alias("status"),
        F.when(ok, F.col("w.target")).alias("target_tpr"),
        F.when(ok, F.col("w.gap")).alias("tpr_gap"),
        F.when(ok, F.col("w.utility")).alias("utility"),
        (ok & F.coalesce(F.col("w.feasible"), F.lit(False))).alias("feasible"),
        F.when(ok, F.col("w.levels")).alias("levels_compared"),
        F.when(ok, F.col("w.skipped")).alias("levels_skipped"),
        "fallback",
        F.when(ok, -F.col("w.ni")).alias("_i"),
    )
    picked = chosen.select(*by_level, F.col("i").alias("_i"), "threshold")
    thresholds = (
        levels.join(policy.where(F.col("status") == "fit").select(*keys, "fallback", "_i"), keys)
        .join(picked, [*by_level, "_i"], "left")
        .select(*by_level, F.coalesce("threshold", "fallback").alias("threshold"))
    )
    return policy.drop("_i"), thresholds


def apply_policy(
    scores: DataFrame, policy: DataFrame, thresholds: DataFrame, keys: Sequence[str], group: str
) -> DataFrame:
    """Add ``level``, ``decision`` and ``used_fallback``; unseen levels use the fallback threshold."""
    keys = list(keys)
    rows = scores.withColumn("level", F.coalesce(F.col(group).cast("string"), F.lit(MISSING)))
    fits = checked_broadcast(policy.where(F.col("status") == "fit").select(*keys, "fallback"))
    cut = checked_broadcast(thresholds.select(*keys, "level", F.col("threshold").alias("_t")))
    joined = rows.join(fits, keys).join(cut, [*keys, "level"], "left")
    return joined.withColumns(
        {
            "decision": F.col("p") >= F.coalesce("_t", "fallback"),
            "used_fallback": F.col("_t").isNull(),
        }
    ).drop("_t", "fallback")


def evaluate_decisions(
    decided: DataFrame, keys: Sequence[str], cost_fp: float = 1.0, cost_fn: float = 5.0
) -> DataFrame:
    """Accuracy, F1, Brier, utility and group gaps of given decisions."""
    keys = list(keys)
    hit, y = F.col("decision"), F.col("y") == 1
    err = F.col("p") - F.col("y")
    per_level = decided.groupBy(*keys, "level").agg(
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"),
        F.count_if(~hit & ~y).alias("tn"),
        F.sum(err * err).alias("_sq"),
        F.count_if("used_fallback").alias("_fb"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = per_level.withColumns(rate_columns(tp, fp, fn, tn))
    sums = rated.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "_sq", "_fb")], *[_gap(x) for x in RATES]
    )
    n = tp + fp + fn + tn
    return sums.select(
        *keys,
        ratio(tp + tn, n).alias("accuracy"),
        (2.0 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))).alias("f1"),
        ratio(F.col("_sq"), n).alias("brier"),
        ratio(tp - cost_fp * fp - cost_fn * fn, n).alias("utility"),
        "tpr_gap",
        "fpr_gap",
        "selection_gap",
        F.greatest("tpr_gap", "fpr_gap", "selection_gap").alias("max_group_gap"),
        "tn",
        "fp",
        "fn",
        "tp",
        F.col("_fb").alias("fallback_rows"),
    )


def reference_row(
    scores: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    group: str,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    benefit_tp: float = 1.0,
    benefit_tn: float = 0.0,
) -> DataFrame:
    """Accuracy, utility and gaps at one threshold per key; NULL groups leave the gaps only."""
    keys = list(keys)
    cuts = checked_broadcast(references.select(*keys, "threshold"))
    rows = scores.join(cuts, keys).withColumn("_hit", F.col("p") >= F.col("threshold"))
    y = F.col("y") == 1
    cells = rows.groupBy(*keys, F.col(group).cast("string").alias("level")).agg(
        F.count_if(F.col("_hit") & y).alias("tp"),
        F.count_if(F.col("_hit") & ~y).alias("fp"),
        F.count_if(~F.col("_hit") & y).alias("fn"),
        F.count_if(~F.col("_hit") & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {k: F.when(F.col("level").isNotNull(), v) for k, v in rate_columns(tp, fp, fn, tn).items()}
    sums = cells.withColumns(rates).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[_gap(x) for x in RATES]
    )
    n = tp + fp + fn + tn
    return sums.select(
        *keys,
        ratio(tp + tn, n).alias("reference_accuracy"),
        ratio(benefit_tp * tp + benefit_tn * tn - cost_fp * fp - cost_fn * fn, n).alias("reference_utility"),
        *[F.col(f"{x}_gap").alias(f"reference_{x}_gap") for x in RATES],
    )


def policy_change(heldout: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Policy minus reference threshold in accuracy, utility and TPR gap."""
    return heldout.join(reference, list(keys)).select(
        *keys,
        (F.col("accuracy") - F.col("reference_accuracy")).alias("accuracy_change"),
        (F.col("utility") - F.col("reference_utility")).alias("utility_change"),
        (F.col("tpr_gap") - F.col("reference_tpr_gap")).alias("tpr_gap_change"),
    )


def constrained_selection(
    candidates: DataFrame,
    keys: Sequence[str],
    order: str,
    min_robustness: float = 0.90,
    max_gap: float = 0.10,
) -> DataFrame:
    """Rank models by feasibility, composite score and violation (one row per model and key).

    The base-rate Brier of the first model in ``order`` serves all models.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    base = F.min_by("base_rate_brier", order).over(w)
    gap = F.col("max_fairness_gap")
    parts = {
        "ranking_component": clip(F.col("AUROC"), 0.0, 1.0),
        "probability_quality_component": clip(1.0 - F.col("Brier") / F.greatest(base, F.lit(1e-12)), 0.0, 1.0),
        "robustness_component": clip(F.col("robustness_retention"), 0.0, 1.0),
        "inverse_group_gap_component": clip(1.0 - gap, 0.0, 1.0),
    }
    product = F.lit(1.0)
    for name in parts:
        product = product * F.col(name)
    scored = candidates.withColumns(parts).withColumns(
        {
            "reliability_score": F.pow(product, F.lit(0.25)),
            "fairness_constraint_ok": F.coalesce(gap <= max_gap, F.lit(False)),
            "robustness_constraint_ok": F.coalesce(F.col("robustness_retention") >= min_robustness, F.lit(False)),
            "constraint_violation": F.coalesce(F.greatest(gap - max_gap, F.when(gap.isNotNull(), F.lit(0.0))), F.lit(1.0))
            + F.when(
                F.col("robustness_retention").isNotNull(),
                F.greatest(min_robustness - F.col("robustness_retention"), F.lit(0.0)),
            ),
        }
    )
    feasible = scored.withColumn("feasible", F.col("fairness_constraint_ok") & F.col("robustness_constraint_ok"))
    place = F.row_number().over(
        w.orderBy(F.desc("feasible"), F.desc_nulls_last("reliability_score"), F.asc_nulls_last("constraint_violation"), order)
    )
    role = (
        F.when((F.col("place") == 1) & F.col("feasible"), "feasible_candidate")
        .when(F.col("place") == 1, "infeasible_fallback")
        .otherwise("not_selected")
    )
    return feasible.withColumn("place", place).withColumn("selection_role", role)


def composite_score(rows: DataFrame, parts: Sequence[str], gap_part: str) -> DataFrame:
    """Geometric mean of parts limited to [0, 1]; not scored when the gap part is missing."""
    product = F.lit(1.0)
    names = [*parts, gap_part]
    for name in names:
        product = product * clip(F.col(name), 0.0, 1.0)
    known = F.col(gap_part).isNotNull()
    limited: Mapping[str, Column] = {n: F.when(known, clip(F.col(n), 0.0, 1.0)).otherwise(F.col(n)) for n in names}
    return rows.withColumn("reliability_score", F.when(known, F.pow(product, F.lit(1.0 / len(names))))).withColumns(
        {
            **limited,
            "score_status": F.when(known, "descriptive_only").otherwise("not_scored_fairness_unavailable"),
        }
    )

"""Paired tests between models and ranks across runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.numeric import ratio, ratio_or_zero
from scorelab.functions.pvalues import chi_square_tail, normal_two_sided
from scorelab.operators.metrics import score_curve
from scorelab.operators.ordering import join_on_value
from scorelab.session import BROADCAST_ROWS, checked_broadcast, materialised

# Studentised range quantile (alpha 0.05) over sqrt(2), for 2 to 10 models.
NEMENYI_Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}

RANKED_METRICS = {"AUROC": True, "AUPRC": True, "F1": True, "MCC": True, "Brier": False}


def model_pairs(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All model pairs (a < b by name) of each key; ``fields`` come as f_a, f_b.

    One group holds one entry per model, so its size is the number of models.
    """
    entry = F.struct("model", *fields)
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    pairs = F.flatten(
        F.transform(
            "_m",
            lambda a, i: F.transform(
                F.slice("_m", i + 2, F.size("_m")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    out = grouped.select(*keys, F.explode(pairs).alias("x"))
    both = [F.col(f"x.{s}.{f}").alias(f"{f}_{s}") for f in ("model", *fields) for s in ("a", "b")]
    return out.select(*keys, *both)


def _shares(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: ``_vp``, the share of negatives below it, and ``_vn``, that of positives above it, ties half.

    Shares come from the cumulative class counts (N log N) of the distinct scores.
    """
    curve = score_curve(scores, [*keys, "model"])
    above = F.col("pos_total") - F.col("pos_before") - F.col("pos")
    return curve.select(
        *keys,
        "model",
        "p",
        (F.col("pos") + F.col("neg")).alias("_n"),
        ratio(F.col("neg_before") + 0.5 * F.col("neg"), F.col("neg_total")).alias("_vp"),
        ratio(above + 0.5 * F.col("pos"), F.col("pos_total")).alias("_vn"),
    )


def _side_by_side(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per case with the ``fields`` of model i as f0, f1, ...; the case's id is no longer needed then."""
    side = [F.max(F.when(F.col("model") == m, F.col(f))).alias(f"{f}{i}") for i, m in enumerate(models) for f in fields]
    wide = rows.groupBy(*keys, "row_id", "y").agg(*side) if side else rows.select(*keys, "row_id", "y")
    return wide.drop("row_id")


def _placed(wide: DataFrame, shares: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Cases (keys, y, p0, p1, ...) with ``v0``, ``v1``, ...: the share of the other class below (y = 1) or above (y = 0) each score.

    The shares of few distinct scores go to the cases, so only models with very many of them cost a shuffle.
    """
    wide = materialised(wide)
    unscored = wide.agg(*[F.max(F.col(f"p{i}").isNull()).alias(f"p{i}") for i in range(len(models))]).first()
    for i, m in enumerate(models):
        p = f"p{i}"
        own = shares.where(F.col("model") == m).select(*keys, F.col("p").alias(p), "_n", "_vp", "_vn")
        scored = wide.where(F.col(p).isNotNull()) if unscored[p] else wide
        v = F.when(F.col("y") == 1, F.col("_vp")).otherwise(F.col("_vn")).alias(f"v{i}")
        few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = scored.join(F.broadcast(own.drop("_n")), [*keys, p]) if few else join_on_value(scored, own, [*keys, p], "_n")
        met = met.select(*wide.columns, v)
        if unscored[p]:
            met = met.unionByName(wide.where(F.col(p).isNull()).withColumn(f"v{i}", F.lit(None).cast("double")))
        wide = met if few else materialised(met)
    return wide


def _models(rows: DataFrame) -> list[str]:
    return [r["model"] for r in rows.select("model").distinct().orderBy("model").collect()]


def _pair_sums(wide: DataFrame, keys: Sequence[str], sums: Callable[[str, str], Mapping[str, Column]], models: Sequence[str]) -> DataFrame:
    """Aggregates of every model pair (a < b) in one pass: keys, y, model_a, model_b and what ``sums`` names.

    A case's models stand side by side in one row (their number is a parameter), so what is read and shuffled
    grows with the models and not with their pairs.
    """
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    if not pairs:
        some = sums("0", "1")
        name = F.lit(None).cast("string")
        empty = wide.select(*keys, "y", name.alias("model_a"), name.alias("model_b")).limit(0)
        return empty.withColumns({n: F.lit(None).cast("double") for n in some})
    entries = [
        F.struct(F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"), *[c.alias(n) for n, c in sums(str(i), str(j)).items()])
        for i, j in pairs
    ]
    out = wide.groupBy(*keys, "y").agg(F.array(*entries).alias("_pairs"))
    return out.select(*keys, "y", F.explode("_pairs").alias("_x")).select(*keys, "y", "_x.*")


def _delong_sums(i: str, j: str) -> dict[str, Column]:
    a, b = f"v{i}", f"v{j}"  # regr_*: cases that both models have scored
    n = F.regr_count(a, b)
    return {
        "n": n, "mean_a": F.regr_avgy(a, b), "mean_b": F.regr_avgx(a, b),
        "var_part": (F.regr_syy(a, b) + F.regr_sxx(a, b) - 2.0 * F.regr_sxy(a, b)) / F.when(n > 1, n - 1) / n,
    }


def _mcnemar_sums(i: str, j: str) -> dict[str, Column]:
    a, b = F.col(f"right{i}"), F.col(f"right{j}")
    return {"b": F.count_if(a & ~b), "c": F.count_if(~a & b), "n_both": F.count_if(a.isNotNull() & b.isNotNull())}


def _delong_test(by_class: DataFrame, on: Sequence[str]) -> DataFrame:
    out = by_class.where(F.col("n") > 0).groupBy(*on).agg(
        F.max(F.when(F.col("y") == 1, F.col("mean_a"))).alias("auc_a"),
        F.max(F.when(F.col("y") == 1, F.col("mean_b"))).alias("auc_b"),
        F.sum("var_part").alias("var_diff"),
    )
    degenerate = F.col("var_diff") <= 0
    z = F.when(degenerate, 0.0).otherwise(
        (F.col("auc_a") - F.col("auc_b")) / F.sqrt(F.when(~degenerate, F.col("var_diff")))
    )
    return out.withColumn("z", z).withColumn("p_value", normal_two_sided("z")).drop("var_diff")


def _mcnemar_test(counts: DataFrame) -> DataFrame:
    gap = (F.abs(F.col("b") - F.col("c")) - 1).cast("double")
    return counts.withColumn("chi2", ratio_or_zero(gap * gap, F.col("b") + F.col("c"))).withColumn(
        "p_value",
        F.when(F.col("b") + F.col("c") == 0, 1.0).otherwise(chi_square_tail("chi2", F.lit(1))),
    )


def _judged(scores: DataFrame, keys: Sequence[str], thresholds: DataFrame | float) -> DataFrame:
    """Rows with ``right``: the decision at the threshold meets the label."""
    if isinstance(thresholds, DataFrame):
        on = [k for k in (*keys, "model") if k in thresholds.columns]
        scores = scores.join(checked_broadcast(thresholds.select(*on, "threshold")), on)
        cut = F.col("threshold")
    else:
        cut = F.lit(float(thresholds))
    return scores.withColumn("right", (F.col("p") >= cut).cast("int") == F.col("y"))


def mcnemar(scores: DataFrame, keys: Sequence[str], thresholds: DataFrame | float = 0.5) -> DataFrame:
    """Continuity-corrected McNemar test of every model pair in each key."""
    keys = list(keys)
    rows = _judged(scores, keys, thresholds)
    models = _models(rows)
    found = _pair_sums(_side_by_side(rows, keys, ["right"], models), keys, _mcnemar_sums, models).where("n_both > 0")
    return _mcnemar_test(found.groupBy(*keys, "model_a", "model_b").agg(F.sum("b").alias("b"), F.sum("c").alias("c")))


def delong(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DeLong test of every model pair: auc_a, auc_b, z, p_value."""
    keys = list(keys)
    shares = materialised(_shares(scores, keys))
    models = _models(shares)
    rows = _placed(_side_by_side(scores, keys, ["p"], models), shares, keys, models)
    return _delong_test(_pair_sums(rows, keys, _delong_sums, models), [*keys, "model_a", "model_b"])


def holm(tests: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """Holm step-down inside each key (one row per model pair)."""
    w = Window.partitionBy(*keys)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(p)) + 1) * F.col(p))
    ranked = tests.withColumn("_step", step)
    running = F.max("_step").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, running).drop("_step")


def pairwise_matrix(scores: DataFrame, keys: Sequence[str], thresholds: DataFrame | float = 0.5) -> DataFrame:
    """DeLong and McNemar for all pairs, both from one pass, the model with the larger AUROC as side a."""
    keys = list(keys)
    on = [*keys, "model_a", "model_b"]
    shares = materialised(_shares(scores, keys))
    models = _models(shares)
    judged = _judged(scores.select(*keys, "model", "row_id", "y", "p"), keys, thresholds)
    rows = _placed(_side_by_side(judged, keys, ["p", "right"], models), shares, keys, models)

    def both(i: str, j: str) -> dict[str, Column]:
        return {**_delong_sums(i, j), **_mcnemar_sums(i, j)}

    sums = materialised(_pair_sums(rows, keys, both, models))
    counts = sums.where("n_both > 0").groupBy(*on).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    joined = _delong_test(sums, on).join(
        _mcnemar_test(counts).select(
            *on, F.col("chi2").alias("mcnemar_chi2"), F.col("p_value").alias("mcnemar_p"),
            F.col("b").alias("mcnemar_b"), F.col("c").alias("mcnemar_c"),
        ),
        on,
    )
    swap = F.col("auc_b") > F.col("auc_a")

    def side(a: str, b: str, name: str):
        return F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)

    rows = joined.select(
        *keys,
        side("model_a", "model_b", "model_a"),
        side("model_b", "model_a", "model_b"),
        side("auc_a", "auc_b", "auc_a"),
        side("auc_b", "auc_a", "auc_b"),
        F.abs(F.col("auc_a") - F.col("auc_b")).alias("auc_diff"),
        F.abs(F.col("z")).alias("delong_z"),
        F.col("p_value").alias("delong_p"),
        "mcnemar_chi2",
        "mcnemar_p",
        side("mcnemar_b", "mcnemar_c", "mcnemar_b"),
        side("mcnemar_c", "mcnemar_b", "mcnemar_c"),
    )
    return holm(holm(rows, keys, "delong_p", "delong_p_holm"), keys, "mcnemar_p", "mcnemar_p_holm")


def block_ranks(blocks: DataFrame, keys: Sequence[str], block: str, higher_is_better: bool = True) -> DataFrame:
    """Rank models (ties averaged) inside each complete block; incomplete blocks drop out.

    A block holds one value per model.
    """
    keys = list(keys)
    models = blocks.groupBy(*keys).agg(F.countDistinct("model").alias("_k"))
    w = Window.partitionBy(*keys, block)
    complete = (
        blocks.where(F.col("value").isNotNull())
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .join(models, keys)
        .where(F.col("_n") == F.col("_k"))
    )
    order = F.desc("value") if higher_is_better else F.asc("value")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, block, "value"))
    rank = F.rank().over(w.orderBy(order)) + (ties - 1) / F.lit(2.0)
    return complete.withColumn("rank", rank).withColumn("_ties", ties).drop("_n", "_k")


def friedman(blocks: DataFrame, keys: Sequence[str], block: str, higher_is_better: bool = True) -> DataFrame:
    """Average ranks, tie-corrected Friedman statistic and Nemenyi critical difference."""
    keys = list(keys)
    ranks = block_ranks(blocks, keys, block, higher_is_better)
    average = ranks.groupBy(*keys, "model").agg(
        F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.col("_ties") * F.col("_ties") - 1).alias("_tie"),
    )
    n, k = F.col("n_runs").cast("double"), F.col("k").cast("double")
    summary = average.groupBy(*keys).agg(
        F.max("n_runs").alias("n_runs"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n_runs") * F.col("n_runs") * F.col("average_rank") * F.col("average_rank")).alias("_ssb"),
        F.sum("_tie").alias("_tie"),
    )
    correction = 1.0 - ratio(F.col("_tie"), n * k * (k * k - 1.0))
    raw = 12.0 / (n * k * (k + 1.0)) * F.col("_ssb") - 3.0 * n * (k + 1.0)
    q = F.create_map(*[F.lit(x) for pair in NEMENYI_Q05.items() for x in pair])
    enough = (F.col("n_runs") >= 2) & (F.col("k") >= 2)
    stats = summary.select(
        *keys,
        F.when(enough, "ok").otherwise("insufficient_runs_or_models").alias("status"),
        "n_runs",
        "k",
        F.when(enough & (F.col("k") > 2), ratio(raw, correction)).alias("friedman_chi2"),
        F.when(enough, F.try_element_at(q, F.col("k").cast("int")) * F.sqrt(k * (k + 1.0) / (6.0 * n))).alias("nemenyi_cd"),
    ).withColumn("friedman_p", chi_square_tail("friedman_chi2", (F.col("k") - 1).cast("int")))
    return average.select(*keys, "model", "average_rank").join(stats, keys)


def significant_pairs(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model pairs of a ``friedman`` result and whether they differ by more than the CD.

    NULL where the CD is unknown: too few runs, or more models than the table of quantiles has.
    """
    pairs = model_pairs(ranks, keys, ["average_rank", "nemenyi_cd"])
    gap = F.abs(F.col("average_rank_a") - F.col("average_rank_b"))
    return pairs.select(
        *keys, "model_a", "model_b", gap.alias("rank_difference"),
        (gap > F.col("nemenyi_cd_a")).alias("significant"),
    )


def descriptive_ranks(metrics: DataFrame, block: str) -> DataFrame:
    """Average rank per metric and model; repeated seeds of a block are averaged first.

    ``metrics`` is long: block, model, metric, value (one row per run).
    """
    means = (
        metrics.where(F.col("metric").isin(list(RANKED_METRICS)))
        .groupBy("metric", block, "model")
        .agg(F.avg("value").alias("value"))
    )
    lower = [m for m, higher in RANKED_METRICS.items() if not higher]
    signed = means.withColumn("value", F.when(F.col("metric").isin(lower), -F.col("value")).otherwise(F.col("value")))
    ranks = block_ranks(signed, ["metric"], block)
    return ranks.groupBy("metric", "model").agg(
        F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n_blocks")
    )


def spearman(rows: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Spearman correlation per key; NULL when a side is constant or has one row.

    For keys whose rows fit a task (features of one explained row).
    """
    w = Window.partitionBy(*keys)

    def ranked(c: str):
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return F.rank().over(w.orderBy(c)) + (ties - 1) / F.lit(2.0)

    r = rows.withColumns({"_rank_a": ranked(a), "_rank_b": ranked(b)})
    return _rank_correlation(r, keys, name)


def spearman_large(rows: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """The same for keys of any size: ranks through range partitions."""
    from scorelab.operators.ordering import average_ranks

    r = average_ranks(average_ranks(rows, keys, a, "_rank_a"), keys, b, "_rank_b")
    return _rank_correlation(r, keys, name)


def _rank_correlation(ranked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    sums = ranked.groupBy(*keys).agg(
        F.covar_pop("_rank_a", "_rank_b").alias("_c"),
        F.var_pop("_rank_a").alias("_va"),
        F.var_pop("_rank_b").alias("_vb"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select(*keys, "n", ratio(F.col("_c"), F.sqrt(F.col("_va")) * F.sqrt(F.col("_vb"))).alias(name))


"""Reliability bins, calibration summaries and calibration maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.grids import Grid
from scorelab.functions.numeric import clip, ratio
from scorelab.operators.metrics import score_counts
from scorelab.operators.ordering import CHUNK, in_chunks, join_on_value, numbered
from scorelab.session import BROADCAST_ROWS, materialised

EPS = 2.220446049250313e-16


def violations(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key that calibration could not use: keys, n, n_bad_label, n_bad_score."""
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("n_bad_label"),
        F.count_if(~finite).alias("n_bad_score"),
    )


def require_valid(scores: DataFrame, keys: Sequence[str], bins: int = 10) -> None:
    """Fail early, with the numbers, when scores are not finite or labels not binary."""
    if bins < 2:
        raise ValueError("bins must be at least 2")
    totals = violations(scores, keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("n_bad_label") + F.col("n_bad_score")).alias("bad")
    ).first()
    if not totals["n"] or totals["bad"]:
        raise ValueError(f"calibration input: {totals['n']} rows, {totals['bad']} unusable")


def reliability_bins(scores: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins; empty ones are left out."""
    edges = Grid.inner_edges(bins)
    p = clip(F.col("p"), EPS, 1.0 - EPS)
    grouped = (
        scores.withColumn("_p", p)
        .withColumn("bin", edges.slot(F.col("_p")))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_predicted"), F.avg("y").alias("observed_rate"))
    )
    width = F.lit(1.0 / bins)
    return grouped.select(
        *keys,
        "bin",
        (F.col("bin") * width).alias("bin_lower"),
        F.when(F.col("bin") == bins - 1, 1.0).otherwise((F.col("bin") + 1) * width).alias("bin_upper"),
        "n",
        "mean_predicted",
        "observed_rate",
        F.abs(F.col("mean_predicted") - F.col("observed_rate")).alias("absolute_gap"),
    )


def calibration_summary(scores: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """n, prevalence, Brier, base-rate Brier, skill, ECE and MCE in one aggregation chain.

    The squared error is summed per bin next to the bin statistics, so the scores
    are read once.
    """
    edges = Grid.inner_edges(bins)
    p = clip(F.col("p"), EPS, 1.0 - EPS)
    err = F.col("_p") - F.col("y")
    per_bin = (
        scores.withColumn("_p", p)
        .withColumn("bin", edges.slot(F.col("_p")))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_p").alias("_sp"),
            F.sum("y").alias("_sy"),
            F.sum(err * err).alias("_sq"),
        )
    )
    gap = F.abs(F.col("_sp") / F.col("_n") - F.col("_sy") / F.col("_n"))
    sums = per_bin.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum("_sy").alias("_y"),
        F.sum("_sq").alias("_sq"),
        F.sum(F.col("_n") * gap).alias("_gap"),
        F.max(gap).alias("mce"),
    )
    prevalence = F.col("_y") / F.col("n")
    base = prevalence * (1.0 - prevalence)
    brier = F.col("_sq") / F.col("n")
    return sums.select(
        *keys,
        "n",
        prevalence.alias("prevalence"),
        brier.alias("brier"),
        base.alias("base_rate_brier"),
        (1.0 - ratio(brier, base)).alias("brier_skill"),
        (F.col("_gap") / F.col("n")).alias("ece"),
        "mce",
    )


#: The parameters of a recalibration lie within +- this.
BOUND = 30.0


def _softplus(eta):
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def _held(value, *pushes):
    """True on a bound that the slope of the likelihood, or the step, pushes against."""
    outward = [((value >= BOUND) & (p > 0)) | ((value <= -BOUND) & (p < 0)) for p in pushes]
    return reduce(lambda a, b: a | b, outward)


def _room(value, step):
    """The share of a step that reaches the bound, 1 if it stays inside."""
    ahead = F.when(step > 0, BOUND - value).otherwise(value + BOUND)
    return F.when(F.abs(step) > ahead, ahead / F.abs(step)).otherwise(1.0)


def _newton_step(cells: DataFrame, params: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """One bounded step for all keys, from grouped score equations and losses.

    A step that raised the loss is halved from where it began. A parameter on its
    bound stays there while the likelihood pushes outwards, and the other one is
    solved alone. (a, b) and c are two fits side by side.
    """
    x, n, pos = F.col("_x"), F.col("_n"), F.col("pos")
    eta, ceta = F.col("a") + F.col("b") * x, F.col("c") + x
    mu, nu = 1.0 / (1.0 + F.exp(-eta)), 1.0 / (1.0 + F.exp(-ceta))
    w, v = n * mu * (1.0 - mu), n * nu * (1.0 - nu)
    state = [c for c in params.columns if c not in keys]
    s = cells.join(params, keys).groupBy(*keys, *state).agg(
        F.sum(n * _softplus(eta) - pos * eta).alias("loss"), F.sum(n * _softplus(ceta) - pos * ceta).alias("closs"),
        F.sum(pos - n * mu).alias("g0"), F.sum((pos - n * mu) * x).alias("g1"),
        F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11"),
        F.sum(pos - n * nu).alias("k0"), F.sum(v).alias("m0"),
    )
    slack = 1e-12 * (1.0 + F.abs(F.col("_loss")))
    s = s.withColumns({
        "_ok": F.col("_loss").isNull() | (F.col("loss") <= F.col("_loss") + slack),
        "_cok": F.col("_closs").isNull() | (F.col("closs") <= F.col("_closs") + 1e-12 * (1.0 + F.abs(F.col("_closs")))),
    })
    g0, g1, h00, h01, h11 = (F.col(c) for c in ("g0", "g1", "h00", "h01", "h11"))
    det = h00 * h11 - h01 * h01
    zero = F.lit(0.0)
    singular = det <= 1e-14 * h00 * h11
    fix_a = _held(F.col("a"), g0, F.coalesce(ratio(h11 * g0 - h01 * g1, det), zero))
    fix_b = _held(F.col("b"), g1, F.coalesce(ratio(h00 * g1 - h01 * g0, det), zero))
    da = F.when(fix_a, zero).when(fix_b | singular, ratio(g0, h00)).otherwise(ratio(h11 * g0 - h01 * g1, det))
    db = F.when(fix_b, zero).when(fix_a, ratio(g1, h11)).when(singular, zero).otherwise(ratio(h00 * g1 - h01 * g0, det))
    dc = F.when(_held(F.col("c"), F.col("k0")), zero).otherwise(ratio(F.col("k0"), F.col("m0")))

    s = s.withColumns({"_na": F.coalesce(da, zero), "_nb": F.coalesce(db, zero), "_nc": F.coalesce(dc, zero)})
    # one factor for both, so the step keeps its direction: at most 5, and not beyond a bound
    longest = F.greatest(F.abs(F.col("_na")), F.abs(F.col("_nb")), F.lit(5.0))
    s = s.withColumn("_scale", F.least(5.0 / longest, _room(F.col("a"), F.col("_na")), _room(F.col("b"), F.col("_nb"))))
    s = s.withColumns({
        "_da": F.when(F.col("_ok"), F.col("_na") * F.col("_scale")).otherwise(F.col("_da") / 2.0),
        "_db": F.when(F.col("_ok"), F.col("_nb") * F.col("_scale")).otherwise(F.col("_db") / 2.0),
        "_dc": F.when(F.col("_cok"), clip(F.col("_nc"), -5.0, 5.0)).otherwise(F.col("_dc") / 2.0),
        "_a": F.when(F.col("_ok"), F.col("a")).otherwise(F.col("_a")),
        "_b": F.when(F.col("_ok"), F.col("b")).otherwise(F.col("_b")),
        "_c": F.when(F.col("_cok"), F.col("c")).otherwise(F.col("_c")),
        "_loss": F.when(F.col("_ok"), F.col("loss")).otherwise(F.col("_loss")),
        "_closs": F.when(F.col("_cok"), F.col("closs")).otherwise(F.col("_closs")),
    })
    moved = {p: clip(F.col(f"_{p}") + F.col(f"_d{p}"), -BOUND, BOUND) for p in "abc"}
    step = F.greatest(*[F.abs(moved[p] - F.col(f"_{p}")) for p in "abc"])
    done = F.col("_ok") & F.col("_cok") & (step < tol)
    return s.select(
        *keys, *[moved[p].alias(p) for p in "abc"],
        *[F.col(c) for c in ("_a", "_b", "_c", "_da", "_db", "_dc", "_loss", "_closs", "_pos", "_neg")],
        (F.col("_rounds") + F.when(F.col("_done"), 0).otherwise(1)).alias("_rounds"),
        (F.col("_done") | done).alias("_done"),
    )


def logistic_recalibration(
    scores: DataFrame, keys: Sequence[str], max_iter: int = 60, tol: float = 1e-9, unrolled: int = 3
) -> DataFrame:
    """Calibration intercept and slope, and calibration in the large, for all keys at once.

    Bounded Newton steps on distinct scores; the parameters (one row per key) are
    written every few steps, which keeps the lineage short. ``calibration_status``
    is ok, one_class (no finite optimum) or not_converged; the values are NULL
    unless it is ok. ``calibration_iterations`` counts the steps.
    """
    if not keys:
        one = logistic_recalibration(scores.withColumn("_all", F.lit(0)), ["_all"], max_iter, tol, unrolled)
        return one.drop("_all")
    keys = list(keys)
    p = clip(F.col("p"), EPS, 1.0 - EPS)
    cells = materialised(
        score_counts(scores, keys)
        .withColumn("_x", F.log(p / (1.0 - p)))
        .select(*keys, "_x", "pos", (F.col("pos") + F.col("neg")).alias("_n"))
    )
    zero, unknown = F.lit(0.0), F.lit(None).cast("double")
    first = materialised(
        cells.groupBy(*keys).agg(F.sum("pos").alias("_pos"), F.sum(F.col("_n") - F.col("pos")).alias("_neg")).withColumns({
            "a": zero, "b": F.lit(1.0), "c": zero, "_a": zero, "_b": F.lit(1.0), "_c": zero, "_da": zero, "_db": zero, "_dc": zero,
            "_loss": unknown, "_closs": unknown, "_rounds": F.lit(0), "_done": F.lit(False),
        })
    )
    # one row of numbers per key; its size does not change from step to step
    small = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    params = first.where((F.col("_pos") > 0) & (F.col("_neg") > 0))
    for done in range(0, max_iter, unrolled):
        for _ in range(min(unrolled, max_iter - done)):
            params = _newton_step(cells, F.broadcast(params) if small else params, keys, tol)
        params = materialised(params)
        if params.where(~F.col("_done")).isEmpty():
            break
    found = params.select(*keys, "a", "b", "c", "_rounds", "_done", F.lit(False).alias("_one"))
    one_class = first.where((F.col("_pos") == 0) | (F.col("_neg") == 0)).select(
        *keys, "a", "b", "c", "_rounds", "_done", F.lit(True).alias("_one")
    )
    every = found.unionByName(one_class)
    return every.select(
        *keys,
        F.when(F.col("_done"), F.col("a")).alias("calibration_intercept"),
        F.when(F.col("_done"), F.col("b")).alias("calibration_slope"),
        F.when(F.col("_done"), F.col("c")).alias("calibration_in_the_large"),
        F.when(F.col("_one"), "one_class").when(F.col("_done"), "ok").otherwise("not_converged").alias("calibration_status"),
        F.col("_rounds").alias("calibration_iterations"),
    )


#: Blocks that one task pools at a time.
POOLED = 50_000


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators of one run of blocks, sorted by score."""
    frame = frame.sort_values("_lo")
    out: list[list[float]] = []
    for lo, hi, w, wy in zip(frame["_lo"], frame["_hi"], frame["_w"], frame["_wy"]):
        out.append([lo, hi, w, wy])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            lo_hi = out.pop()
            out[-1][1] = lo_hi[1]
            out[-1][2] += lo_hi[2]
            out[-1][3] += lo_hi[3]
    made = pd.DataFrame(out, columns=["_lo", "_hi", "_w", "_wy"])
    for c in frame.columns:
        if c not in made.columns:
            made[c] = frame[c].iloc[0] if len(frame) else None
    return made[frame.columns.tolist()]


def isotonic_blocks(scores: DataFrame, keys: Sequence[str], pooled: int = POOLED) -> DataFrame:
    """The monotone map of every key as a table: keys, _lo, _hi (scores) and _v (value on them).

    Adjacent violators may be pooled in any order, so runs of at most ``pooled``
    blocks are pooled side by side, with run borders that shift by half a run
    each time, until a pass over both borders changes nothing.
    """
    keys = list(keys)
    blocks = score_counts(scores, keys).select(
        *keys, F.col("p").alias("_lo"), F.col("p").alias("_hi"),
        (F.col("pos") + F.col("neg")).cast("double").alias("_w"), F.col("pos").cast("double").alias("_wy"),
    )
    blocks = materialised(blocks)
    quiet, turn = 0, 0
    while True:
        size = blocks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if size <= pooled:
            runs = blocks.withColumn("_run", F.lit(0).cast("long"))
        else:
            place = F.col("_rn") + (pooled // 2 if turn % 2 else 0)
            runs = numbered(blocks, keys, ["_lo"], "_rn").withColumn("_run", F.floor(place / pooled)).drop("_rn", "_rn_total")
        before = blocks.count()
        blocks = materialised(runs.groupBy(*keys, "_run").applyInPandas(_pool, runs.schema).drop("_run"))
        quiet, turn = (quiet + 1 if blocks.count() == before else 0), turn + 1
        if size <= pooled or quiet == 2:
            return blocks.select(*keys, "_lo", "_hi", (F.col("_wy") / F.col("_w")).alias("_v"))


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join in which missing keys meet each other."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in on})
    return left.join(other, [left[k].eqNullSafe(other[f"_of_{k}"]) for k in on], how).drop(*[f"_of_{k}" for k in on])


def isotonic_map(fit_scores: DataFrame, apply_scores: DataFrame, keys: Sequence[str] = (), name: str = "p") -> DataFrame:
    """Fit a monotone map per key on ``fit_scores`` and apply it, linear between blocks and clipped outside.

    The map stays a table. Distinct scores and blocks are sorted together by range,
    and each score meets the block before and the one after it.
    """
    keys = list(keys)
    if not keys:
        one = [df.withColumn("_all", F.lit(0)) for df in (fit_scores, apply_scores)]
        return isotonic_map(*one, ["_all"], name).drop("_all")
    none = F.lit(None).cast("double")
    marks = isotonic_blocks(fit_scores, keys).select(*keys, F.col("_lo").alias("_at"), F.lit(0).alias("_kind"), "_lo", "_hi", "_v")
    rows = apply_scores.withColumn(name, F.col(name).cast("double"))
    asked = rows.groupBy(*keys, F.col(name).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_at", F.lit(1).alias("_kind"), none.alias("_lo"), none.alias("_hi"), none.alias("_v"), "_n"
    )
    both = in_chunks(marks.withColumn("_n", F.lit(0).cast("long")).unionByName(asked), keys, ["_at", "_kind"])
    block = F.when(F.col("_kind") == 0, F.struct("_lo", "_hi", "_v"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy("_at", "_kind")
    # what follows is looked up backwards: a frame to the end of its partition is walked again for every row
    behind = Window.partitionBy(*keys, CHUNK).orderBy(F.desc("_at"), F.desc("_kind"))
    ends = both.where(F.col("_kind") == 0).groupBy(*keys, CHUNK).agg(F.min(block).alias("_first"), F.max(block).alias("_last"))
    chunks = _null_safe(both.select(*keys, CHUNK).distinct(), ends, [*keys, CHUNK], "left")
    before = Window.unboundedPreceding, -1
    carried = chunks.select(
        *keys, CHUNK,
        F.last("_last", True).over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*before)).alias("_back"),
        F.last("_first", True).over(Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(*before)).alias("_ahead"),
    )
    met = _null_safe(both.hint("merge"), carried, [*keys, CHUNK], "inner").withColumns({
        "_low": F.coalesce(F.last(block, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_back")),
        "_high": F.coalesce(F.last(block, True).over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.col("_ahead")),
    }).where(F.col("_kind") == 1)
    x, low, high = F.col("_at"), F.col("_low"), F.col("_high")
    between = low["_v"] + (high["_v"] - low["_v"]) * ratio(x - low["_hi"], high["_lo"] - low["_hi"])
    value = F.when(low.isNull(), high["_v"]).when((x <= low["_hi"]) | high.isNull(), low["_v"]).otherwise(between)
    # every score of the rows was asked for, null keys included; a score that very many rows share is broadcast to them
    mapped = met.select(*keys, F.col("_at").alias(name), value.alias("_mapped"), "_n")
    keep = [c for c in apply_scores.columns if c != name]
    return join_on_value(rows, mapped, [*keys, name], "_n").select(*keep, F.col("_mapped").alias(name))

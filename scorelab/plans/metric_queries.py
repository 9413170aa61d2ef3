"""Queries over the scores table: metrics, thresholds, tests, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.grids import SWEEP, TUNING
from scorelab.operators import calibrate, compare, metrics, thresholds
from scorelab.plans.base import (
    SQL_CURVE, SQL_SCORES, query, r, scores, tidy, with_sql,
)

KEYS = ["run_id", "model"]
CURVE = with_sql(SQL_SCORES, SQL_CURVE)


@query("auroc", CURVE + f"""SELECT run_id, model, {r('sum(pos * (neg_before + 0.5::DOUBLE * neg) / (pos_total * neg_total))', 'AUROC')}
FROM curve GROUP BY ALL""")
def auroc(spark, d):
    return tidy(metrics.ranking_metrics(scores(spark, d), KEYS).select(*KEYS, "AUROC"))


@query("average_precision", CURVE + f"""SELECT run_id, model,
  {r('sum(pos / pos_total * (pos_total - pos_before) / (pos_total - pos_before + neg_total - neg_before))', 'AUPRC')}
FROM curve GROUP BY ALL""")
def average_precision(spark, d):
    return tidy(metrics.ranking_metrics(scores(spark, d), KEYS).select(*KEYS, "AUPRC"))


CONFUSION = """conf AS (
  SELECT run_id, model, count(*) FILTER (p >= 0.5::DOUBLE AND y = 1) AS tp, count(*) FILTER (p >= 0.5::DOUBLE AND y = 0) AS fp,
         count(*) FILTER (p < 0.5::DOUBLE AND y = 1) AS fn, count(*) FILTER (p < 0.5::DOUBLE AND y = 0) AS tn,
         avg((p - y) * (p - y)) AS brier
  FROM scores GROUP BY ALL)"""


@query("confusion_counts", with_sql(SQL_SCORES, CONFUSION) + """SELECT run_id, model, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN" FROM conf""")
def confusion_counts(spark, d):
    return tidy(metrics.confusion(scores(spark, d), KEYS))


RATES = """rates AS (
  SELECT *, tp / (tp + fn + 1e-10::DOUBLE) AS rec, tn / (tn + fp + 1e-10::DOUBLE) AS spec,
         coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS prec,
         coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
         coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
  FROM conf)"""


@query("threshold_rates", with_sql(SQL_SCORES, CONFUSION, RATES) + f"""SELECT run_id, model, {r('rec', 'Recall')}, {r('spec', 'Specificity')},
  {r('prec', 'Precision')}, {r('f1', 'F1')}, {r('sqrt(rec * spec)', 'G-Mean')}, {r('mcc', 'MCC')} FROM rates""")
def threshold_rates(spark, d):
    c = metrics.confusion(scores(spark, d), KEYS)
    cells = metrics.confusion_columns(*[F.col(x) for x in ("TP", "FP", "FN", "TN")])
    names = ["Recall", "Specificity", "Precision", "F1", "G-Mean", "MCC"]
    return tidy(c.select(*KEYS, *[cells[n].alias(n) for n in names]))


@query("brier", with_sql(SQL_SCORES) + f"""SELECT run_id, model, {r('avg((p - y) * (p - y))', 'Brier')} FROM scores GROUP BY ALL""")
def brier(spark, d):
    err = F.col("p") - F.col("y")
    return tidy(scores(spark, d).groupBy(*KEYS).agg(F.avg(err * err).alias("Brier")))


RANKING = """ranking AS (
  SELECT run_id, model, sum(pos * (neg_before + 0.5::DOUBLE * neg) / (pos_total * neg_total)) AS auroc,
         sum(pos / pos_total * (pos_total - pos_before) / (pos_total - pos_before + neg_total - neg_before)) AS auprc
  FROM curve GROUP BY ALL)"""
FULL = with_sql(SQL_SCORES, SQL_CURVE, RANKING, CONFUSION, RATES)


@query("metric_rows", FULL + f"""SELECT run_id, model, {r('auroc', 'AUROC')}, {r('auprc', 'AUPRC')}, {r('f1', 'F1')}, {r('prec', 'Precision')},
  {r('rec', 'Recall')}, {r('spec', 'Specificity')}, {r('sqrt(rec * spec)', 'G-Mean')}, {r('mcc', 'MCC')}, {r('brier', 'Brier')},
  tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", 0.5::DOUBLE AS threshold FROM rates JOIN ranking USING (run_id, model)""")
def metric_rows(spark, d):
    return tidy(metrics.metric_rows(scores(spark, d), KEYS))


@query("results_table", FULL + """, wide4 AS (SELECT run_id, model, auroc, auprc, f1, prec, rec, spec, sqrt(rec * spec) AS gm, mcc, brier
  FROM rates JOIN ranking USING (run_id, model))
SELECT run_id, model, round_even(auroc, 4) AS "AUROC", round_even(auprc, 4) AS "AUPRC", round_even(f1, 4) AS "F1",
  round_even(prec, 4) AS "Precision", round_even(rec, 4) AS "Recall", round_even(spec, 4) AS "Specificity",
  round_even(gm, 4) AS "G-Mean", round_even(mcc, 4) AS "MCC", round_even(brier, 4) AS "Brier" FROM wide4""")
def results_table(spark, d):
    rows = metrics.metric_rows(scores(spark, d), KEYS)
    return tidy(metrics.results_table(metrics.long_metrics(rows, KEYS), KEYS))


@query("roc_points", CURVE + f"""SELECT run_id, model, {r('p', 'threshold')}, {r('(neg_total - neg_before) / neg_total', 'fpr')},
  {r('(pos_total - pos_before) / pos_total', 'tpr')} FROM curve""")
def roc_points(spark, d):
    return tidy(metrics.roc_points(scores(spark, d), KEYS))


@query("pr_points", CURVE + f"""SELECT run_id, model, {r('p', 'threshold')},
  {r('(pos_total - pos_before) / (pos_total - pos_before + neg_total - neg_before)', 'precision')},
  {r('(pos_total - pos_before) / pos_total', 'recall')}, {r('pos_total / (pos_total + neg_total)', 'prevalence')} FROM curve""")
def pr_points(spark, d):
    return tidy(metrics.pr_points(scores(spark, d), KEYS))


@query("normalised_confusion", with_sql(SQL_SCORES) + f""", cells AS (
  SELECT run_id, model, y AS actual, CASE WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM scores GROUP BY ALL)
SELECT run_id, model, actual::BIGINT AS actual, predicted::BIGINT AS predicted, n,
  {r('n::DOUBLE / sum(n) OVER (PARTITION BY run_id, model, actual)', 'share')} FROM cells""")
def normalised_confusion(spark, d):
    return tidy(metrics.normalised_confusion(scores(spark, d), KEYS))


@query("class_distribution", with_sql(SQL_SCORES) + f"""SELECT run_id, y::BIGINT AS y, count(*) AS n,
  {r('100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY run_id)', 'pct')} FROM wide GROUP BY run_id, y""")
def class_distribution(spark, d):
    one = scores(spark, d).where(F.col("model") == "disc")
    return tidy(metrics.class_distribution(one, ["run_id"]))


@query("representative_cases", with_sql(SQL_SCORES) + f""", cells AS (
  SELECT *, CASE WHEN p >= 0.5::DOUBLE AND y = 1 THEN 'TP' WHEN p >= 0.5::DOUBLE THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS cell FROM scores)
SELECT run_id, model, cell, row_id, {r('p', 'p')} FROM cells
QUALIFY row_number() OVER (PARTITION BY run_id, model, cell ORDER BY abs(p - 0.5::DOUBLE), row_id) = 1""")
def representative_cases(spark, d):
    return tidy(metrics.representative_cases(scores(spark, d), KEYS))


# --- thresholds -----------------------------------------------------------------


def grid_sql(grid, name):
    return f"""{name} AS (SELECT i, {grid.start!r}::DOUBLE + i * {grid.step!r}::DOUBLE AS t FROM range({grid.size}) g(i))"""


POINTS = """points AS (
  SELECT run_id, model, i, t, sum(pos) FILTER (p >= t) AS tp0, sum(neg) FILTER (p >= t) AS fp0,
         max(pos_total) AS np, max(neg_total) AS nn
  FROM curve, grid GROUP BY ALL),
cells AS (
  SELECT run_id, model, i, t, coalesce(tp0, 0)::DOUBLE AS tp, coalesce(fp0, 0)::DOUBLE AS fp,
         np - coalesce(tp0, 0)::DOUBLE AS fn, nn - coalesce(fp0, 0)::DOUBLE AS tn FROM points)"""

BEST = with_sql(SQL_SCORES, SQL_CURVE, grid_sql(TUNING, "grid"), POINTS) + """, parts AS (
  SELECT *, (tp + fp + fn = 0) OR (tn + fp + fn = 0) AS single, tp / (tp + fn + 1e-10::DOUBLE) AS sens,
         tn / (tn + fp + 1e-10::DOUBLE) AS spec, tp / (tp + fp + 1e-10::DOUBLE) AS prec FROM cells),
crit AS (
  SELECT run_id, model, i, t, 'f1' AS criterion, CASE WHEN single THEN 0 ELSE 2.0::DOUBLE * prec * sens / (prec + sens + 1e-10::DOUBLE) END AS score FROM parts
  UNION ALL SELECT run_id, model, i, t, 'g_mean', CASE WHEN single THEN 0 ELSE sqrt(sens * spec) END FROM parts
  UNION ALL SELECT run_id, model, i, t, 'youden', CASE WHEN single THEN 0 ELSE sens + spec - 1.0::DOUBLE END FROM parts
  UNION ALL SELECT run_id, model, i, t, 'cost', CASE WHEN single THEN 0 ELSE (tp - fp - 5.0::DOUBLE * fn) / (tp + fp + fn + tn) END FROM parts),
best AS (SELECT * FROM crit QUALIFY row_number() OVER (PARTITION BY run_id, model, criterion ORDER BY score DESC, i) = 1)
"""


@query("optimal_thresholds", BEST + f"SELECT run_id, model, criterion, {r('t', 'threshold')}, {r('score', 'score')} FROM best")
def optimal_thresholds(spark, d):
    return tidy(thresholds.optimal_thresholds(scores(spark, d), KEYS))


SWEPT = with_sql(SQL_SCORES, SQL_CURVE, grid_sql(SWEEP, "grid"), POINTS) + """, swept AS (
  SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS prec,
         CASE WHEN (tp + fp + fn = 0) OR (tn + fp + fn = 0) THEN 0 ELSE tp END / (tp + fn + 1e-10::DOUBLE) AS rec,
         CASE WHEN (tp + fp + fn = 0) OR (tn + fp + fn = 0) THEN 0 ELSE tn END / (tn + fp + 1e-10::DOUBLE) AS spec FROM cells)
"""


@query("threshold_sweep", SWEPT + f"""SELECT run_id, model, i, {r('t', 'threshold')}, {r('f1', 'F1')}, {r('sqrt(rec * spec)', 'G-Mean')},
  {r('prec', 'Precision')}, {r('rec', 'Recall')},
  row_number() OVER (PARTITION BY run_id, model ORDER BY f1 DESC, i) = 1 AS best_f1 FROM swept""")
def threshold_sweep(spark, d):
    return tidy(thresholds.threshold_sweep(scores(spark, d), KEYS))


@query("nearest_threshold_row", SWEPT + f""", target AS (SELECT run_id, model, avg(p) AS target FROM scores GROUP BY ALL)
SELECT run_id, model, {r('target', 'target')}, {r('t', 'threshold')}, {r('f1', 'F1')} FROM swept JOIN target USING (run_id, model)
QUALIFY row_number() OVER (PARTITION BY run_id, model ORDER BY abs(t - target), t) = 1""")
def nearest_threshold_row(spark, d):
    s = scores(spark, d)
    rows = thresholds.threshold_sweep(s, KEYS).select(*KEYS, "threshold", "F1")
    targets = s.groupBy(*KEYS).agg(F.avg("p").alias("target"))
    return tidy(thresholds.nearest_grid_row(rows, targets, KEYS))


# --- paired tests ---------------------------------------------------------------

MCNEMAR = """hits AS (SELECT run_id, row_id, model, (p >= 0.5::DOUBLE)::INT = y AS ok FROM scores),
mcn AS (
  SELECT a.run_id, a.model AS model_a, b.model AS model_b, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (NOT a.ok AND b.ok) AS c
  FROM hits a JOIN hits b ON a.run_id = b.run_id AND a.row_id = b.row_id AND a.model < b.model GROUP BY ALL),
mcnemar AS (SELECT *, CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1)::DOUBLE * (abs(b - c) - 1) / (b + c) END AS chi2 FROM mcn)"""


@query("mcnemar", with_sql(SQL_SCORES, MCNEMAR) + f"SELECT run_id, model_a, model_b, b, c, {r('chi2', 'chi2')} FROM mcnemar")
def mcnemar(spark, d):
    return tidy(compare.mcnemar(scores(spark, d), ["run_id"]).drop("p_value"))


DELONG = """placed AS (
  SELECT run_id, model, p, (neg_before + 0.5::DOUBLE * neg) / neg_total AS vp,
         (pos_total - pos_before - pos + 0.5::DOUBLE * pos) / pos_total AS vn FROM curve),
v AS (SELECT s.run_id, s.model, s.row_id, s.y, CASE WHEN s.y = 1 THEN vp ELSE vn END AS v
      FROM scores s JOIN placed USING (run_id, model, p)),
cls AS (
  SELECT a.run_id, a.model AS model_a, b.model AS model_b, a.y, count(*) AS n, avg(a.v) AS ma, avg(b.v) AS mb,
         var_samp(a.v) + var_samp(b.v) - 2 * covar_samp(a.v, b.v) AS vv
  FROM v a JOIN v b ON a.run_id = b.run_id AND a.row_id = b.row_id AND a.model < b.model GROUP BY ALL),
delong AS (
  SELECT run_id, model_a, model_b, max(ma) FILTER (y = 1) AS auc_a, max(mb) FILTER (y = 1) AS auc_b, sum(vv / n) AS vd FROM cls GROUP BY ALL)"""


@query("delong", with_sql(SQL_SCORES, SQL_CURVE, DELONG) + f"""SELECT run_id, model_a, model_b, {r('auc_a', 'auc_a')}, {r('auc_b', 'auc_b')},
  {r('CASE WHEN vd <= 0 THEN 0 ELSE (auc_a - auc_b) / sqrt(vd) END', 'z', 6)} FROM delong""")
def delong(spark, d):
    return tidy(compare.delong(scores(spark, d), ["run_id"]).drop("p_value"), z=6)


@query("pairwise_matrix", with_sql(SQL_SCORES, SQL_CURVE, DELONG, MCNEMAR) + f""", j AS (
  SELECT run_id, model_a, model_b, auc_a, auc_b, CASE WHEN vd <= 0 THEN 0 ELSE abs(auc_a - auc_b) / sqrt(vd) END AS z, chi2, b, c
  FROM delong JOIN mcnemar USING (run_id, model_a, model_b))
SELECT run_id, CASE WHEN auc_b > auc_a THEN model_b ELSE model_a END AS model_a, CASE WHEN auc_b > auc_a THEN model_a ELSE model_b END AS model_b,
  {r('greatest(auc_a, auc_b)', 'auc_a')}, {r('least(auc_a, auc_b)', 'auc_b')}, {r('abs(auc_a - auc_b)', 'auc_diff')}, {r('z', 'delong_z', 6)},
  {r('chi2', 'mcnemar_chi2')}, CASE WHEN auc_b > auc_a THEN c ELSE b END AS mcnemar_b, CASE WHEN auc_b > auc_a THEN b ELSE c END AS mcnemar_c FROM j""")
def pairwise_matrix(spark, d):
    m = compare.pairwise_matrix(scores(spark, d), ["run_id"])
    return tidy(m.drop("delong_p", "mcnemar_p", "delong_p_holm", "mcnemar_p_holm"), delong_z=6)


@query("pairwise_p_values")
def pairwise_p_values(spark, d):
    m = compare.pairwise_matrix(scores(spark, d), ["run_id"])
    return m.select("run_id", "model_a", "model_b", "delong_p", "delong_p_holm", "mcnemar_p", "mcnemar_p_holm")


# --- calibration ----------------------------------------------------------------

BINNED = f"""edges AS (SELECT i + 1 AS k, (i + 1) * 0.1::DOUBLE AS e FROM range(9) g(i)),
clipped AS (SELECT run_id, model, y, least(greatest(p, {calibrate.EPS!r}::DOUBLE), {1 - calibrate.EPS!r}::DOUBLE) AS p FROM scores),
distinct_p AS (SELECT run_id, model, p, count(*) AS n, sum(y) AS sy FROM clipped GROUP BY ALL),
binned AS (SELECT d.*, (SELECT count(*) FROM edges WHERE e <= d.p) AS bin FROM distinct_p d),
bins AS (SELECT run_id, model, bin, sum(n)::BIGINT AS n, sum(n * p) / sum(n) AS mp, sum(sy)::DOUBLE / sum(n) AS obs FROM binned GROUP BY ALL)"""


@query("reliability_bins", with_sql(SQL_SCORES, BINNED) + f"""SELECT run_id, model, bin, {r('bin * 0.1::DOUBLE', 'bin_lower')},
  {r('CASE WHEN bin = 9 THEN 1 ELSE (bin + 1) * 0.1::DOUBLE END', 'bin_upper')}, n, {r('mp', 'mean_predicted')}, {r('obs', 'observed_rate')},
  {r('abs(mp - obs)', 'absolute_gap')} FROM bins""")
def reliability_bins(spark, d):
    return tidy(calibrate.reliability_bins(scores(spark, d), KEYS))


@query("calibration_summary", with_sql(SQL_SCORES, BINNED) + f""", e AS (
  SELECT run_id, model, sum(n * abs(mp - obs)) / sum(n) AS ece, max(abs(mp - obs)) AS mce FROM bins GROUP BY ALL),
s AS (SELECT run_id, model, count(*) AS n, avg(y) AS prev, avg((p - y) * (p - y)) AS brier FROM clipped GROUP BY ALL)
SELECT run_id, model, n, {r('prev', 'prevalence')}, {r('brier', 'brier')}, {r('prev * (1 - prev)', 'base_rate_brier')},
  {r('1 - brier / nullif(prev * (1 - prev), 0)', 'brier_skill')}, {r('ece', 'ece')}, {r('mce', 'mce')} FROM s JOIN e USING (run_id, model)""")
def calibration_summary(spark, d):
    return tidy(calibrate.calibration_summary(scores(spark, d), KEYS))


@query("calibration_input_check", with_sql(SQL_SCORES) + """SELECT run_id, model, count(*) AS n, 0::BIGINT AS n_bad_label, 0::BIGINT AS n_bad_score
FROM scores GROUP BY ALL""")
def calibration_input_check(spark, d):
    return tidy(calibrate.violations(scores(spark, d), KEYS))


NEWTON = with_sql(SQL_SCORES, SQL_CURVE).replace("WITH ", "WITH RECURSIVE ", 1) + f""", cells0 AS (
  SELECT run_id, model, ln(q / (1 - q)) AS x, pos::DOUBLE AS pos, (pos + neg)::DOUBLE AS n
  FROM (SELECT *, least(greatest(p, {calibrate.EPS!r}::DOUBLE), {1 - calibrate.EPS!r}::DOUBLE) AS q FROM counts)),
newton AS (
  SELECT run_id, model, 0 AS it, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT DISTINCT run_id, model FROM cells0)
  UNION ALL
  SELECT run_id, model, it + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), c + k0 / m0
  FROM (
    SELECT run_id, model, it, a, b, c, sum(pos - n * mu) AS g0, sum((pos - n * mu) * x) AS g1, sum(n * mu * (1 - mu)) AS h00,
           sum(n * mu * (1 - mu) * x) AS h01, sum(n * mu * (1 - mu) * x * x) AS h11, sum(pos - n * nu) AS k0, sum(n * nu * (1 - nu)) AS m0
    FROM (SELECT w.*, x, pos, n, 1 / (1 + exp(-(a + b * x))) AS mu, 1 / (1 + exp(-(c + x))) AS nu
          FROM newton w JOIN cells0 USING (run_id, model)) GROUP BY run_id, model, it, a, b, c)
  WHERE it < 15)
"""


@query("calibration_slope", NEWTON + f"""SELECT run_id, model, {r('a', 'calibration_intercept', 6)}, {r('b', 'calibration_slope', 6)},
  {r('c', 'calibration_in_the_large', 6)}, 'ok' AS calibration_status FROM newton WHERE it = 15""")
def calibration_slope(spark, d):
    return tidy(calibrate.logistic_recalibration(scores(spark, d), KEYS).drop("calibration_iterations"), digits=6)


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    """The maps of all models, fitted on one run and applied to the other."""
    s = scores(spark, d)
    fit, held = (s.where(F.col("run_id") == x) for x in ("run_F", "run_O"))
    return calibrate.isotonic_map(fit, held, ["model"]).select("run_id", "model", "row_id", "y", "p")


@query("isotonic_invariants", with_sql(SQL_SCORES) + """SELECT run_id, model, true AS rises, true AS keeps_totals, true AS in_range
FROM scores GROUP BY run_id, model""")
def isotonic_invariants(spark, d):
    """What makes a map isotonic: it rises, keeps the label total of its own fit, and stays in [0, 1]."""
    own, keys = scores(spark, d), ["run_id", "model"]
    blocks = calibrate.isotonic_blocks(own, keys)
    step = F.lag("_v").over(Window.partitionBy(*keys).orderBy("_lo"))
    rising = blocks.withColumn("_up", F.col("_v") > F.coalesce(step, F.lit(-1.0))).groupBy(*keys).agg(F.min("_up").alias("rises"))
    mapped = calibrate.isotonic_map(own, own, keys)
    totals = mapped.groupBy(*keys).agg(
        (F.abs(F.sum("p") - F.sum("y")) < 1e-6 * (1 + F.sum("y"))).alias("keeps_totals"), F.min((F.col("p") >= 0) & (F.col("p") <= 1)).alias("in_range")
    )
    return rising.join(totals, keys)


@query("isotonic_values", with_sql(SQL_SCORES) + f""", c AS (SELECT run_id, model, floor(p * 100) / 100.0::DOUBLE AS raw, count(*) AS n, sum(y) AS ys FROM scores GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(ys) OVER w AS cy FROM c WINDOW w AS (PARTITION BY run_id, model ORDER BY raw)),
m AS (SELECT a.run_id, a.model, a.i AS a, b.i AS b, (b.cy - a.cy + a.ys)::DOUBLE / (b.cn - a.cn + a.n) AS v FROM o a JOIN o b ON a.run_id = b.run_id AND a.model = b.model AND a.i <= b.i),
l AS (SELECT o.run_id, o.model, o.raw, m.a, min(v) AS v FROM o JOIN m ON o.run_id = m.run_id AND o.model = m.model AND m.a <= o.i AND m.b >= o.i GROUP BY ALL)
SELECT run_id, model, {r('raw', 'raw')}, {r('max(v)', 'value')} FROM l GROUP BY run_id, model, raw""")
def isotonic_values(spark, d):
    """The fitted value of every score in steps of 0.01, for all rows; the SQL takes the largest of the least means."""
    raw = F.floor(F.col("p") * 100) / F.lit(100.0)
    own = scores(spark, d).withColumns({"p": raw, "raw": raw})
    mapped = calibrate.isotonic_map(own, own, ["run_id", "model"])
    return tidy(mapped.groupBy("run_id", "model", "raw").agg(F.max("p").alias("value")))

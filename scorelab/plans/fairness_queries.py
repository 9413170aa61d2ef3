"""Queries for group fairness, policies and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.functions.grids import FAIRNESS
from scorelab.functions.hashing import MIX_32, STEP_32
from scorelab.operators import bootstrap, fairness, metrics, thresholds
from scorelab.plans.base import MODELS, SQL_LINE_ID, SQL_SCORES, line_id, query, r, table, tidy, wide_scores, with_sql

GROUPS = ["priority", "segment"]
GRID = f"grid AS (SELECT i, {FAIRNESS.start!r}::DOUBLE + i * {FAIRNESS.step!r}::DOUBLE AS t FROM range({FAIRNESS.size}) g(i))"


def grouped(spark, d):
    """Scores with two group columns; segment has missing values."""
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    seg = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment"))
    g = (
        li.select(line_id().alias("row_id"), "l_orderkey")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select("row_id", F.col("o_orderpriority").alias("priority"), seg.alias("segment"))
    )
    # the three scores of a line move together
    return wide_scores(spark, d).join(g, "row_id").unpivot(["row_id", "run_id", "y", "priority", "segment"], list(MODELS), "model", "p")


SQL_GROUPED = SQL_SCORES + f""",
grp AS (SELECT {SQL_LINE_ID} AS row_id, o_orderpriority AS priority, nullif(c_mktsegment, 'FURNITURE') AS segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
gs AS (SELECT s.*, priority, segment FROM scores s JOIN grp USING (row_id)),
melted AS (SELECT run_id, model, row_id, y, p, 'priority' AS group_column, priority AS level FROM gs
  UNION ALL SELECT run_id, model, row_id, y, p, 'segment', segment FROM gs WHERE segment IS NOT NULL)"""

RATES05 = """cell AS (SELECT run_id, model, group_column, level, count(*) AS n, avg((p >= 0.5::DOUBLE)::INT) AS selection,
  avg((p >= 0.5::DOUBLE)::INT) FILTER (y = 1) AS tpr, avg((p >= 0.5::DOUBLE)::INT) FILTER (y = 0) AS fpr FROM melted GROUP BY ALL)"""


@query("group_rates", with_sql(SQL_GROUPED, RATES05) + f"""SELECT run_id, model, group_column, level, n, {r('selection', 'selection')}, {r('tpr', 'tpr')}, {r('fpr', 'fpr')} FROM cell""")
def group_rates(spark, d):
    return tidy(fairness.group_rates(grouped(spark, d), ["run_id", "model"], GROUPS))


@query("rate_gaps", with_sql(SQL_GROUPED, RATES05) + f"""SELECT run_id, model, group_column, {r('max(selection) - min(selection)', 'selection_gap')},
  {r('max(tpr) - min(tpr)', 'tpr_gap')}, {r('max(fpr) - min(fpr)', 'fpr_gap')},
  {r('greatest(max(selection) - min(selection), max(tpr) - min(tpr), max(fpr) - min(fpr))', 'max_gap')} FROM cell GROUP BY ALL""")
def rate_gaps(spark, d):
    rates = fairness.group_rates(grouped(spark, d), ["run_id", "model"], GROUPS)
    return tidy(fairness.rate_gaps(rates, ["run_id", "model"]))


CURVE = with_sql(SQL_GROUPED, GRID) + """, pts AS (
  SELECT run_id, model, i, t, (count(*) FILTER (p >= t AND y = 1))::DOUBLE AS tp, (count(*) FILTER (p >= t AND y = 0))::DOUBLE AS fp,
         (count(*) FILTER (p < t AND y = 1))::DOUBLE AS fn, (count(*) FILTER (p < t AND y = 0))::DOUBLE AS tn FROM scores, grid GROUP BY ALL),
cell AS (
  SELECT run_id, model, i, group_column, level, avg((p >= t)::INT) AS selection, avg((p >= t)::INT) FILTER (y = 1) AS tpr,
         avg((p >= t)::INT) FILTER (y = 0) AS fpr FROM melted, grid GROUP BY ALL),
gaps AS (SELECT run_id, model, i, group_column, max(selection) - min(selection) AS selection, max(tpr) - min(tpr) AS tpr, max(fpr) - min(fpr) AS fpr FROM cell GROUP BY ALL),
wide_gaps AS (SELECT run_id, model, i, max(selection) FILTER (group_column = 'priority') AS ps, max(tpr) FILTER (group_column = 'priority') AS pt,
  max(fpr) FILTER (group_column = 'priority') AS pf, max(selection) FILTER (group_column = 'segment') AS ss, max(tpr) FILTER (group_column = 'segment') AS st,
  max(fpr) FILTER (group_column = 'segment') AS sf, max(greatest(selection, tpr, fpr)) AS mg FROM gaps GROUP BY ALL),
fcurve AS (SELECT p.*, (tp - fp - 5 * fn) / (tp + fp + fn + tn) AS u, ps, pt, pf, ss, st, sf, mg FROM pts p JOIN wide_gaps USING (run_id, model, i)),
flagged AS (SELECT b.*, NOT EXISTS (SELECT 1 FROM fcurve a WHERE a.run_id = b.run_id AND a.model = b.model AND a.u >= b.u AND a.mg <= b.mg AND (a.u > b.u OR a.mg < b.mg)) AS opt FROM fcurve b)
"""


@query("fairness_curve", CURVE + f"""SELECT run_id, model, i, {r('t', 'threshold')}, {r('u', 'expected_utility')}, tp::BIGINT AS "TP", fp::BIGINT AS "FP", fn::BIGINT AS "FN",
  tn::BIGINT AS "TN", {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'F1')}, {r('ps', 'priority_selection_gap')}, {r('pt', 'priority_tpr_gap')},
  {r('pf', 'priority_fpr_gap')}, {r('ss', 'segment_selection_gap')}, {r('st', 'segment_tpr_gap')}, {r('sf', 'segment_fpr_gap')},
  {r('mg', 'max_group_gap')}, opt AS pareto_optimal FROM flagged""")
def fairness_curve(spark, d):
    c = fairness.fairness_curve(grouped(spark, d), ["run_id", "model"], GROUPS)
    gaps = [f"{g}_{x}_gap" for g in GROUPS for x in fairness.RATES]
    return tidy(c.select("run_id", "model", "i", "threshold", "expected_utility", "TP", "FP", "FN", "TN", "F1", *gaps, "max_group_gap", "pareto_optimal"))


@query("pareto_thresholds", CURVE + f"SELECT run_id, model, {r('t', 'threshold')}, {r('u', 'expected_utility')}, {r('mg', 'max_group_gap')} FROM flagged WHERE opt")
def pareto_thresholds(spark, d):
    c = fairness.fairness_curve(grouped(spark, d), ["run_id", "model"], GROUPS)
    return tidy(c.where("pareto_optimal").select("run_id", "model", "threshold", "expected_utility", "max_group_gap"))


# policies are fitted on run_F (training side) and judged on run_O


def _sides(spark, d):
    g = grouped(spark, d)
    return g.where(F.col("run_id") == "run_F").drop("run_id"), g.where(F.col("run_id") == "run_O").drop("run_id")


POLICY = with_sql(SQL_GROUPED) + """, fit AS (SELECT model, y, p, coalesce(segment, '__MISSING__') AS level FROM gs WHERE run_id = 'run_F'),
grid AS (SELECT i, 0.01::DOUBLE + i * 0.01::DOUBLE AS t FROM range(98) g(i)),
fd AS (SELECT model, level, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM fit GROUP BY ALL),
fpts AS (SELECT model, i, t, coalesce(sum(pos) FILTER (p >= t), 0) AS tp, coalesce(sum(neg) FILTER (p >= t), 0) AS fp, sum(pos) AS np FROM fd, grid GROUP BY ALL),
fsc AS (SELECT model, i, t, tp / (tp + fp + 1e-10::DOUBLE) AS prec, tp / (np + 1e-10::DOUBLE) AS sens FROM fpts),
fall AS (SELECT model, t AS fallback FROM fsc QUALIFY row_number() OVER (PARTITION BY model ORDER BY 2.0::DOUBLE * prec * sens / (prec + sens + 1e-10::DOUBLE) DESC, i) = 1),
ord AS (SELECT model, level, p, row_number() OVER (PARTITION BY model, level ORDER BY p) - 1 AS rn, count(*) OVER (PARTITION BY model, level) AS n FROM fit),
q AS (SELECT CASE WHEN i = 200 THEN 1.0::DOUBLE ELSE i * 0.005::DOUBLE END AS q FROM range(201) g(i)),
pos_q AS (SELECT model, level, n, (n - 1) * q AS h FROM (SELECT DISTINCT model, level, n FROM ord), q),
ends AS (SELECT x.model, x.level, h - floor(h) AS g, a.p AS lo, b.p AS hi FROM pos_q x
  JOIN ord a ON a.model = x.model AND a.level = x.level AND a.rn = floor(h) JOIN ord b ON b.model = x.model AND b.level = x.level AND b.rn = least(floor(h) + 1, x.n - 1)),
cand AS (SELECT DISTINCT model, level, CASE WHEN g >= 0.5 THEN hi - (hi - lo) * (1 - g) ELSE lo + (hi - lo) * g END AS th FROM ends
  UNION SELECT DISTINCT model, level, -1e-12::DOUBLE FROM fit UNION SELECT DISTINCT model, level, 1.0::DOUBLE + 1e-12::DOUBLE FROM fit),
cnt AS (SELECT c.model, c.level, th, coalesce(sum(pos) FILTER (p >= th), 0) AS tp, coalesce(sum(neg) FILTER (p >= th), 0) AS fp, sum(pos) AS np, sum(neg) AS nn
  FROM cand c JOIN fd ON fd.model = c.model AND fd.level = c.level GROUP BY ALL),
cu AS (SELECT *, tp / np AS tpr, (tp - fp - 5 * (np - tp)) / (np + nn) AS u FROM cnt),
tg AS (SELECT i AS ti, i * 0.01::DOUBLE AS target FROM range(101) g(i)),
ch AS (SELECT * FROM cu, tg QUALIFY row_number() OVER (PARTITION BY model, level, ti ORDER BY abs(tpr - target), u DESC, th DESC) = 1),
pol AS (SELECT model, ti, target, max(tpr) - min(tpr) AS gap, (sum(tp) - sum(fp) - 5 * (sum(np) - sum(tp))) / (sum(np) + sum(nn)) AS u, count(*) AS levels FROM ch GROUP BY ALL),
win AS (SELECT *, gap <= 0.1::DOUBLE AS feasible FROM pol QUALIFY row_number() OVER (PARTITION BY model ORDER BY gap <= 0.1::DOUBLE DESC,
  CASE WHEN gap <= 0.1::DOUBLE THEN u ELSE -gap END DESC, CASE WHEN gap <= 0.1::DOUBLE THEN -gap ELSE u END DESC, ti) = 1),
thr AS (SELECT ch.model, ch.level, ch.th FROM ch JOIN win USING (model, ti)),
held AS (SELECT gs.model, row_id, y, p, coalesce(segment, '__MISSING__') AS level, segment, fallback FROM gs JOIN fall USING (model) WHERE run_id = 'run_O'),
dec AS (SELECT held.*, p >= coalesce(th, fallback) AS decision, th IS NULL AS fb, p >= fallback AS ref FROM held LEFT JOIN thr ON thr.model = held.model AND thr.level = held.level)
"""


@query("equal_opportunity_policy", POLICY + f"""SELECT model, 'fit' AS status, {r('target', 'target_tpr')}, {r('gap', 'tpr_gap')}, {r('u', 'utility')}, feasible,
  levels AS levels_compared, 0::BIGINT AS levels_skipped, {r('fallback', 'fallback')} FROM win JOIN fall USING (model)""")
def equal_opportunity_policy(spark, d):
    fit, _ = _sides(spark, d)
    return tidy(fairness.fit_equal_opportunity(fit, ["model"], "segment")[0])


@query("equal_opportunity_thresholds", POLICY + f"SELECT model, level, {r('th', 'threshold')} FROM thr")
def equal_opportunity_thresholds(spark, d):
    fit, _ = _sides(spark, d)
    return tidy(fairness.fit_equal_opportunity(fit, ["model"], "segment")[1])


EVALUATED = POLICY + """, ev AS (SELECT model, level, (count(*) FILTER (decision AND y = 1))::DOUBLE AS tp, (count(*) FILTER (decision AND y = 0))::DOUBLE AS fp,
  (count(*) FILTER (NOT decision AND y = 1))::DOUBLE AS fn, (count(*) FILTER (NOT decision AND y = 0))::DOUBLE AS tn, sum((p - y) * (p - y)) AS sq, count(*) FILTER (fb) AS fb FROM dec GROUP BY ALL),
er AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, (tp + fp) / (tp + fp + fn + tn) AS sel FROM ev),
es AS (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(sq) AS sq, sum(fb)::BIGINT AS fb, max(tpr) - min(tpr) AS tg, max(fpr) - min(fpr) AS fg,
  max(sel) - min(sel) AS sg FROM er GROUP BY model),
rv AS (SELECT model, segment, (count(*) FILTER (ref AND y = 1))::DOUBLE AS tp, (count(*) FILTER (ref AND y = 0))::DOUBLE AS fp,
  (count(*) FILTER (NOT ref AND y = 1))::DOUBLE AS fn, (count(*) FILTER (NOT ref AND y = 0))::DOUBLE AS tn FROM dec GROUP BY ALL),
rs AS (SELECT model, (sum(tp) + sum(tn)) / (sum(tp) + sum(fp) + sum(fn) + sum(tn)) AS acc, (sum(tp) - sum(fp) - 5 * sum(fn)) / (sum(tp) + sum(fp) + sum(fn) + sum(tn)) AS u,
  max(tp / nullif(tp + fn, 0)) FILTER (segment IS NOT NULL) - min(tp / nullif(tp + fn, 0)) FILTER (segment IS NOT NULL) AS tg FROM rv GROUP BY model)
"""


@query("policy_evaluation", EVALUATED + f"""SELECT model, {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r('2 * tp / greatest(2 * tp + fp + fn, 1)', 'f1')},
  {r('sq / (tp + fp + fn + tn)', 'brier')}, {r('(tp - fp - 5 * fn) / (tp + fp + fn + tn)', 'utility')}, {r('tg', 'tpr_gap')}, {r('fg', 'fpr_gap')}, {r('sg', 'selection_gap')},
  {r('greatest(tg, fg, sg)', 'max_group_gap')}, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, fb AS fallback_rows FROM es""")
def policy_evaluation(spark, d):
    fit, held = _sides(spark, d)
    policy, cuts = fairness.fit_equal_opportunity(fit, ["model"], "segment")
    decided = fairness.apply_policy(held, policy, cuts, ["model"], "segment")
    return tidy(fairness.evaluate_decisions(decided, ["model"]))


@query("policy_change", EVALUATED + f"""SELECT model, {r('(tp + tn) / (tp + fp + fn + tn) - acc', 'accuracy_change')},
  {r('(tp - fp - 5 * fn) / (tp + fp + fn + tn) - u', 'utility_change')}, {r('es.tg - rs.tg', 'tpr_gap_change')} FROM es JOIN rs USING (model)""")
def policy_change(spark, d):
    fit, held = _sides(spark, d)
    policy, cuts = fairness.fit_equal_opportunity(fit, ["model"], "segment")
    decided = fairness.apply_policy(held, policy, cuts, ["model"], "segment")
    ref = fairness.reference_row(held, policy.select("model", F.col("fallback").alias("threshold")), ["model"], "segment")
    return tidy(fairness.policy_change(fairness.evaluate_decisions(decided, ["model"]), ref, ["model"]))


# selection inputs: per-run metrics with stand-in robustness and gap values taken from the data

CANDIDATES = with_sql(SQL_GROUPED) + """, cand AS (
  SELECT run_id, model, 0.5::DOUBLE + avg(p) / 3 AS auroc, avg((p - y) * (p - y)) AS brier, avg(y) * (1 - avg(y)) AS base,
         1.0::DOUBLE - stddev_pop(p) / 2 AS rob, CASE WHEN model <> 'qty' THEN abs(avg(p) FILTER (priority = '5-LOW') - avg(p) FILTER (priority = '1-URGENT')) * 10 END AS gap
  FROM gs GROUP BY run_id, model),
comp AS (SELECT *, least(greatest(auroc, 0), 1) AS c1, least(greatest(1 - brier / greatest(first_value(base) OVER (PARTITION BY run_id ORDER BY model), 1e-12::DOUBLE), 0), 1) AS c2,
  least(greatest(rob, 0), 1) AS c3, CASE WHEN gap IS NOT NULL THEN least(greatest(1 - gap, 0), 1) END AS c4 FROM cand),
sel AS (SELECT *, pow(c1 * c2 * c3 * c4, 0.25::DOUBLE) AS score, coalesce(gap <= 0.1::DOUBLE, false) AS fok, rob >= 0.87::DOUBLE AS rok,
  coalesce(CASE WHEN gap IS NOT NULL THEN greatest(gap - 0.1::DOUBLE, 0) END, 1) + greatest(0.87::DOUBLE - rob, 0) AS viol FROM comp),
placed AS (SELECT *, fok AND rok AS feasible, row_number() OVER (PARTITION BY run_id ORDER BY fok AND rok DESC, score DESC NULLS LAST, viol, model) AS place FROM sel)
"""


def _candidates(spark, d):
    g = grouped(spark, d)
    gap = F.abs(
        F.avg(F.when(F.col("priority") == "5-LOW", F.col("p"))) - F.avg(F.when(F.col("priority") == "1-URGENT", F.col("p")))
    ) * 10.0
    err = F.col("p") - F.col("y")
    c = g.groupBy("run_id", "model").agg(
        (0.5 + F.avg("p") / 3.0).alias("AUROC"),
        F.avg(err * err).alias("Brier"),
        (F.avg("y") * (1.0 - F.avg("y"))).alias("base_rate_brier"),
        (1.0 - F.stddev_pop("p") / 2.0).alias("robustness_retention"),
        gap.alias("_gap"),
    )
    return c.withColumn("max_fairness_gap", F.when(F.col("model") != "qty", F.col("_gap"))).drop("_gap")


@query("constrained_selection", CANDIDATES + f"""SELECT run_id, model, {r('c1', 'ranking_component')}, {r('c2', 'probability_quality_component')}, {r('c3', 'robustness_component')},
  {r('c4', 'inverse_group_gap_component')}, {r('score', 'reliability_score')}, feasible, {r('viol', 'constraint_violation')}, place,
  CASE WHEN place = 1 AND feasible THEN 'feasible_candidate' WHEN place = 1 THEN 'infeasible_fallback' ELSE 'not_selected' END AS selection_role FROM placed""")
def constrained_selection(spark, d):
    out = fairness.constrained_selection(_candidates(spark, d), ["run_id"], "model", min_robustness=0.87)
    return tidy(out.select("run_id", "model", "ranking_component", "probability_quality_component", "robustness_component",
                           "inverse_group_gap_component", "reliability_score", "feasible", "constraint_violation", "place", "selection_role"))


@query("composite_score", CANDIDATES + f"""SELECT run_id, model, {r('CASE WHEN gap IS NULL THEN auroc ELSE c1 END', 'AUROC')}, {r('CASE WHEN gap IS NULL THEN rob ELSE c3 END', 'robustness_retention')},
  {r('c4', 'inverse_gap')}, {r('pow(c1 * c3 * c4, (1.0::DOUBLE / 3))', 'reliability_score')},
  CASE WHEN gap IS NULL THEN 'not_scored_fairness_unavailable' ELSE 'descriptive_only' END AS score_status FROM comp""")
def composite_score(spark, d):
    rows = _candidates(spark, d).withColumn("inverse_gap", F.when(F.col("max_fairness_gap").isNotNull(), F.greatest(1.0 - F.col("max_fairness_gap"), F.lit(0.0))))
    out = fairness.composite_score(rows.select("run_id", "model", "AUROC", "robustness_retention", "inverse_gap"), ["AUROC", "robustness_retention"], "inverse_gap")
    return tidy(out)


# --- bootstrap -------------------------------------------------------------------

REPS = 2000


def doc_scores(spark, d):
    """Unbalanced labels joined with documents: three scores per labelled document."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    wide = j.select(
        F.col("doc_id").alias("row_id"),
        F.col("toxic").alias("y"),
        "lang",
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("length"),
        ((F.col("doc_id") * 37 % 101) / 101.0).alias("spread"),
        ((F.col("quality") + F.col("doc_id") % 7) / 8.0).alias("coarse"),
    )
    return wide.unpivot(["row_id", "y", "lang"], ["length", "spread", "coarse"], "model", "p")


SQL_DOCS = """dwide AS (SELECT doc_id AS row_id, toxic AS y, lang, n_chars / (n_chars + 2000.0::DOUBLE) AS length, (doc_id * 37 % 101) / 101.0::DOUBLE AS spread,
  (quality + doc_id % 7) / 8.0::DOUBLE AS coarse FROM labels JOIN documents USING (doc_id)),
ds AS (SELECT row_id, y, lang, 'length' AS model, length AS p FROM dwide UNION ALL SELECT row_id, y, lang, 'spread', spread FROM dwide
  UNION ALL SELECT row_id, y, lang, 'coarse', coarse FROM dwide)"""


def _poisson_sql(u):
    mass = 2.718281828459045 ** -1
    total, out = mass, []
    for k in range(1, 13):
        out.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
        mass /= k
        total += mass
    return " + ".join(out)


def _mixing_sql(start: str, extra: str) -> tuple[str, str]:
    """The counter hash as a chain of tables; ``start`` has row_id, rep, x and k1."""
    out, last = [], start
    for turn in range(2):
        for i, (shift, factor) in enumerate(MIX_32):
            name = f"{extra}{turn}{i}"
            x = "xor(x, k1)" if turn and not i else "x"
            out.append(f"{name}x AS (SELECT row_id, rep, k1, xor({x}, ({x}) >> {shift}) AS x FROM {last})")
            out.append(f"{name} AS (SELECT row_id, rep, k1, ((x & 65535) * {factor} + (((x >> 16) * {factor}) & 65535) * 65536) & 4294967295 AS x FROM {name}x)")
            last = name
    return ",\n".join(out), last


_MIXED, _LAST = _mixing_sql("k_start", "mix")
SQL_DRAWS = f"""k_rows AS (SELECT row_id, md5(concat_ws('|', '42', row_id)) AS h FROM dwide),
k_start AS (SELECT row_id, rep, (('0x' || substr(h, 1, 8))::BIGINT + rep * {STEP_32}) & 4294967295 AS x, ('0x' || substr(h, 9, 8))::BIGINT AS k1 FROM k_rows, range({REPS}) g(rep)),
{_MIXED},
uu AS (SELECT row_id, rep, x / 4294967296.0::DOUBLE AS u FROM {_LAST}),
ww AS (SELECT row_id, rep, {_poisson_sql('u')} AS w FROM uu)"""

SQL_REPS = SQL_DOCS + ",\n" + SQL_DRAWS + """,
bc AS (SELECT model, rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM ds JOIN ww USING (row_id) WHERE w > 0 GROUP BY ALL),
bcv AS (SELECT *, coalesce(sum(pos) OVER o, 0) AS pb, coalesce(sum(neg) OVER o, 0) AS nb, sum(pos) OVER a AS np, sum(neg) OVER a AS nn FROM bc
  WINDOW o AS (PARTITION BY model, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY model, rep)),
bm AS (SELECT model, rep, max(np) AS np, max(nn) AS nn, sum(pos * (nb + 0.5::DOUBLE * neg) / nullif(np * nn, 0)) AS auroc, sum(pos / nullif(np, 0) * (np - pb) / nullif(np - pb + nn - nb, 0)) AS auprc,
  sum(pos * (p - 1) * (p - 1) + neg * p * p) / (max(np) + max(nn)) AS brier, coalesce(sum(pos) FILTER (p >= 0.5::DOUBLE), 0) AS tp, coalesce(sum(neg) FILTER (p >= 0.5::DOUBLE), 0) AS fp FROM bcv GROUP BY ALL),
bw AS (SELECT model, rep, auroc, auprc, brier, coalesce(2 * tp / nullif(2 * tp + fp + (np - tp), 0), 0) AS f1,
  coalesce((tp * (nn - fp) - fp * (np - tp)) / nullif(sqrt((tp + fp) * np * nn * (np - tp + nn - fp)), 0), 0) AS mcc FROM bm WHERE np > 0 AND nn > 0),
bl AS (SELECT model, rep, 'AUROC' AS metric, auroc AS v FROM bw UNION ALL SELECT model, rep, 'AUPRC', auprc FROM bw UNION ALL SELECT model, rep, 'Brier', brier FROM bw
  UNION ALL SELECT model, rep, 'F1', f1 FROM bw UNION ALL SELECT model, rep, 'MCC', mcc FROM bw)"""

SCOPE = f"'{bootstrap.SCOPE}' AS inference_scope"


def _replicates(spark, d):
    s = doc_scores(spark, d)
    half = s.select("model").distinct().withColumn("threshold", F.lit(0.5))
    return bootstrap.replicate_metrics(s.drop("lang"), half, [], REPS)


@query("bootstrap_intervals", with_sql(SQL_REPS) + f"""SELECT model, metric, {r('avg(v)', 'estimate', 7)}, {r('quantile_cont(v, 0.025::DOUBLE)', 'ci_low', 7)},
  {r('quantile_cont(v, 0.975::DOUBLE)', 'ci_high', 7)}, count(*) AS bootstrap_reps, {SCOPE} FROM bl GROUP BY ALL""")
def bootstrap_intervals(spark, d):
    return tidy(bootstrap.metric_intervals(_replicates(spark, d), []), digits=7)


@query("bootstrap_differences", with_sql(SQL_REPS) + f""", dd AS (SELECT a.model AS model_a, b.model AS model_b, metric, a.v - b.v AS v FROM bl a JOIN bl b USING (metric, rep) WHERE a.model < b.model)
SELECT model_a, model_b, metric, {r('avg(v)', 'difference_mean', 7)}, {r('quantile_cont(v, 0.025::DOUBLE)', 'ci_low', 7)},
  {r('quantile_cont(v, 0.975::DOUBLE)', 'ci_high', 7)}, count(*) AS bootstrap_reps, {SCOPE} FROM dd GROUP BY ALL""")
def bootstrap_differences(spark, d):
    return tidy(bootstrap.paired_differences(_replicates(spark, d), []), digits=7)


@query("bootstrap_exact_draws", with_sql(SQL_DOCS) + f"""SELECT rep, count(*) AS draws, count(*) AS rows_in_all FROM dwide, range({REPS}) g(rep) GROUP BY rep""")
def bootstrap_exact_draws(spark, d):
    """Every replicate draws exactly as many rows as there are; each row keeps one weight per replicate."""
    w = bootstrap.with_multinomial_weights(doc_scores(spark, d), ["row_id"], 0, REPS - 1, 42)
    return tidy(bootstrap.draw_totals(w))


@query("bootstrap_multinomial")
def bootstrap_multinomial(spark, d):
    s = doc_scores(spark, d).drop("lang")
    half = s.select("model").distinct().withColumn("threshold", F.lit(0.5))
    return bootstrap.metric_intervals(bootstrap.replicate_metrics(s, half, [], REPS, mode="multinomial"), [])


POLICY_BOOT = with_sql(SQL_DOCS, SQL_DRAWS) + """, pr AS (SELECT row_id, y, CASE WHEN lang <> 'de' THEN lang END AS lang, spread >= 0.5::DOUBLE AS ref, coarse >= 0.5::DOUBLE AS cand FROM dwide),
m AS (SELECT rep, 'lang' AS gc, coalesce(lang, '__MISSING__') AS level, y, w, ref, cand FROM pr JOIN ww USING (row_id) WHERE w > 0
  UNION ALL SELECT rep, 'all', 'all', y, w, ref, cand FROM pr JOIN ww USING (row_id) WHERE w > 0),
sd AS (SELECT *, 'r' AS side, ref AS hit FROM m UNION ALL SELECT *, 'c', cand FROM m),
ce AS (SELECT rep, gc, level, side, sum(w)::DOUBLE AS n, coalesce(sum(w) FILTER (y = 1), 0)::DOUBLE AS np, coalesce(sum(w) FILTER (y = 1 AND hit), 0)::DOUBLE AS tp,
  coalesce(sum(w) FILTER (y = 0 AND hit), 0)::DOUBLE AS fp FROM sd GROUP BY ALL),
gp AS (SELECT rep, side, CASE WHEN count(*) >= 2 THEN max((tp + fp) / n) - min((tp + fp) / n) END AS s, CASE WHEN count(tp / nullif(np, 0)) >= 2 THEN max(tp / nullif(np, 0)) - min(tp / nullif(np, 0)) END AS t,
  CASE WHEN count(fp / nullif(n - np, 0)) >= 2 THEN max(fp / nullif(n - np, 0)) - min(fp / nullif(n - np, 0)) END AS f FROM ce WHERE gc = 'lang' GROUP BY ALL),
mt AS (SELECT rep, side, 'lang_selection_gap' AS metric, s AS v FROM gp UNION ALL SELECT rep, side, 'lang_tpr_gap', t FROM gp UNION ALL SELECT rep, side, 'lang_fpr_gap', f FROM gp
  UNION ALL SELECT rep, side, 'max_group_gap', greatest(s, t, f) FROM gp UNION ALL SELECT rep, side, 'accuracy', (tp + (n - np - fp)) / n FROM ce WHERE gc = 'all'
  UNION ALL SELECT rep, side, 'utility', (tp - fp - 5 * (np - tp)) / n FROM ce WHERE gc = 'all'),
df AS (SELECT metric, c.v - r.v AS v FROM mt c JOIN mt r USING (rep, metric) WHERE c.side = 'c' AND r.side = 'r' AND c.v IS NOT NULL AND r.v IS NOT NULL)
"""


@query("bootstrap_policy_differences", POLICY_BOOT + f"""SELECT metric, {r('avg(v)', 'difference', 7)}, {r('quantile_cont(v, 0.025::DOUBLE)', 'ci_low', 7)},
  {r('quantile_cont(v, 0.975::DOUBLE)', 'ci_high', 7)}, count(*) AS bootstrap_reps FROM df GROUP BY metric""")
def bootstrap_policy_differences(spark, d):
    s = doc_scores(spark, d)
    rows = s.groupBy("row_id", "y", "lang").agg(
        F.max(F.when(F.col("model") == "spread", F.col("p"))).alias("a"), F.max(F.when(F.col("model") == "coarse", F.col("p"))).alias("b")
    ).select("row_id", "y", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), (F.col("a") >= 0.5).alias("reference"), (F.col("b") >= 0.5).alias("candidate"))
    return tidy(bootstrap.policy_differences(rows, [], ["lang"], REPS), digits=7)

"""Queries for robustness, explanations, cross-run summaries and report repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import compare, explain, metrics, robust, splits, summary
from scorelab.plans.base import MODELS, query, r, table, tidy, with_sql
from scorelab.plans.data_queries import SQL_FEATURES, loan_features

# --- robustness --------------------------------------------------------------------

SHAKEN = ["BILL_total", "balance", "months", "SEX"]
SEED = 42
SPLIT = "1999-01-01"


def borrowers(spark, d):
    f = loan_features(spark, d)
    return f.select(
        "row_id", "y", "orig", F.col("total").alias("BILL_total"), "balance", "months", F.col("fold").cast("double").alias("SEX")
    )


def sides(spark, d):
    b = borrowers(spark, d)
    at = F.lit(SPLIT).cast("timestamp")
    return b.where(F.col("orig") < at), b.where(F.col("orig") >= at)


def logistic(df):
    def x(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    eta = (x("BILL_total") - 250000.0) / 150000.0 + x("balance") / 10000.0 - x("months") / 2000.0 + x("SEX") / 10.0
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-eta)))


def _eta_sql(total="bill", balance="balance", months="months", sex="sex"):
    return f"""1.0::DOUBLE / (1.0::DOUBLE + exp(-((coalesce({total}, 0) - 250000.0::DOUBLE) / 150000.0::DOUBLE + coalesce({balance}, 0) / 10000.0::DOUBLE
    - coalesce({months}, 0) / 2000.0::DOUBLE + coalesce({sex}, 0) / 10.0::DOUBLE)))"""


def _u(seed, *parts):
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _z(*parts):
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_u('42a', *parts)})) * cos(2.0::DOUBLE * pi() * {_u('42b', *parts)}))"


def _changed(col, name, block, shifted):
    out = f"""CASE WHEN k = 'missingness' AND {_u(42, 'row_id', f"'{name}'")} < lv THEN {col}_md
    WHEN k = 'correlated_missingness' AND {_u(42, 'row_id', f"'{block}'")} < lv THEN {col}_md
    WHEN k = 'numeric_noise' THEN {col} + lv * {_z('row_id', f"'{name}'")} * {col}_sd"""
    if shifted:
        out += f" WHEN k = 'covariate_shift' THEN {col} + lv * {col}_sd"
    return out + f" ELSE {col} END AS {col}"


SQL_SHAKEN = SQL_FEATURES + f""",
bor AS (SELECT row_id, y, orig, total AS bill, balance, months, fold::DOUBLE AS sex FROM feats),
prof AS (SELECT {', '.join(f'coalesce(median({c}), 0) AS {c}_md, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_sd' for c in ('bill', 'balance', 'months'))}
  FROM bor WHERE orig < TIMESTAMP '{SPLIT}'),
sc(k, lv) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in robust.scenarios())}),
test AS (SELECT bor.*, prof.*, k, lv, {_eta_sql()} AS p0 FROM bor, prof, sc WHERE orig >= TIMESTAMP '{SPLIT}'),
shaken AS (SELECT row_id, y, k, lv, p0, sex, {_changed('bill', 'BILL_total', 'repayment', True)}, {_changed('balance', 'balance', 'other', False)},
  {_changed('months', 'months', 'other', False)} FROM test)"""


@query("perturbed_rows", with_sql(SQL_SHAKEN) + f"""SELECT row_id, k AS perturbation, {r('lv', 'level')}, {r('bill', 'BILL_total', 4)}, {r('balance', 'balance', 4)},
  {r('months', 'months', 4)}, {r('sex', 'SEX')} FROM shaken""")
def perturbed_rows(spark, d):
    train, test = sides(spark, d)
    profile = robust.train_profile(train, robust.perturbable(SHAKEN, ["SEX"]))
    out = robust.perturb(robust.with_scenarios(test), profile, SHAKEN, SEED)
    return tidy(out.select("row_id", "perturbation", "level", *SHAKEN), BILL_total=4, balance=4, months=4)


ROBUST = with_sql(SQL_SHAKEN) + f""", rs AS (SELECT k, lv, y, p0, {_eta_sql()} AS p FROM shaken),
rc AS (SELECT k, lv, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM rs GROUP BY ALL),
rv AS (SELECT *, coalesce(sum(neg) OVER o, 0) AS nb, sum(pos) OVER a AS np, sum(neg) OVER a AS nn FROM rc
  WINDOW o AS (PARTITION BY k, lv ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY k, lv)),
ra AS (SELECT k, lv, sum(pos * (nb + 0.5::DOUBLE * neg) / (np * nn)) AS auroc FROM rv GROUP BY ALL),
rb AS (SELECT k, lv, avg((p - y) * (p - y)) AS brier, avg(abs(p - p0)) AS shift, avg(((p >= 0.5::DOUBLE) <> (p0 >= 0.5::DOUBLE))::INT) AS flips,
  count(*) FILTER (p >= 0.5::DOUBLE AND y = 1) AS tp, count(*) FILTER (p >= 0.5::DOUBLE AND y = 0) AS fp FROM rs GROUP BY ALL),
rt AS (SELECT *, max(auroc) FILTER (k = 'none') OVER () AS a0, max(brier) FILTER (k = 'none') OVER () AS b0 FROM ra JOIN rb USING (k, lv))
"""


@query("robustness_table", ROBUST + f"""SELECT k AS perturbation, {r('lv', 'level')}, {r('auroc', 'AUROC', 7)}, {r('brier', 'Brier', 7)}, tp AS "TP", fp AS "FP",
  {r('shift', 'mean_abs_probability_shift', 7)}, {r('flips', 'decision_flip_rate', 7)}, {r('auroc / a0', 'AUROC_retention', 7)},
  {r('1 - (brier - b0) / b0', 'Brier_retention', 7)} FROM rt""")
def robustness_table(spark, d):
    train, test = sides(spark, d)
    profile = robust.train_profile(train, robust.perturbable(SHAKEN, ["SEX"]))
    t = robust.robustness_table(test, profile, SHAKEN, logistic, 0.5, SEED)
    return tidy(t.select("perturbation", "level", "AUROC", "Brier", "TP", "FP", "mean_abs_probability_shift", "decision_flip_rate",
                         "AUROC_retention", "Brier_retention"), digits=7)


#: Training rows that selection-side robustness is judged on: a sampling operator of fixed size.
SELECTION_ROWS = 2000
SELECTED = f"ORDER BY ('0x' || substr(md5('{SEED}|' || row_id), 1, 8))::BIGINT, row_id LIMIT {SELECTION_ROWS}"
ROBUST_TRAIN = ROBUST.replace(
    f"FROM bor, prof, sc WHERE orig >= TIMESTAMP '{SPLIT}'",
    f"FROM (SELECT * FROM bor WHERE orig < TIMESTAMP '{SPLIT}' {SELECTED}) bor, prof, sc",
)


@query("selection_robustness", ROBUST_TRAIN + f"SELECT {r('avg(auroc / a0)', 'robustness_retention', 7)}, count(*) AS scenarios FROM rt WHERE k <> 'none'")
def selection_robustness(spark, d):
    """Mean AUROC retention over the perturbed scenarios, judged on a sample of the training side only."""
    train, _ = sides(spark, d)
    profile = robust.train_profile(train, robust.perturbable(SHAKEN, ["SEX"]))
    judged = splits.exact_sample(train, SELECTION_ROWS, SEED)
    t = robust.robustness_table(judged, profile, SHAKEN, logistic, 0.5, SEED).where(F.col("perturbation") != "none")
    return tidy(t.agg(F.avg("AUROC_retention").alias("robustness_retention"), F.count(F.lit(1)).alias("scenarios")), digits=7)


# --- explanations --------------------------------------------------------------------


def embedded(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("i", "v")).select(
        "row_id", "i", F.format_string("e%02d", "i").alias("feature"), F.col("v").cast("double").alias("v")
    )


def main_values(spark, d):
    return embedded(spark, d).select("row_id", "feature", F.col("v").alias("value"))


def local_values(spark, d):
    i = F.col("i")
    scale = (1.0 + (i * 7 % 5) / 10.0) * F.when(i % 3 == 0, -1.0).otherwise(1.0)
    value = F.when(i % 4 == 3, 0.0).otherwise(F.col("v") * scale)
    return embedded(spark, d).select("row_id", "feature", value.alias("value"))


def repeated_values(spark, d):
    rep = embedded(spark, d).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    noise = 1.0 + ((F.col("row_id") * 31 + F.col("i") * 17 + F.col("repeat") * 13) % 11) / 10.0
    return rep.select("row_id", "repeat", "feature", (F.col("v") * noise).alias("value"))


SQL_VALUES = """emb AS (SELECT vec_id AS row_id, i - 1 AS i, 'e' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, embedding[i]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
loc AS (SELECT row_id, feature, CASE WHEN i % 4 = 3 THEN 0 ELSE v * ((1.0::DOUBLE + (i * 7 % 5) / 10.0::DOUBLE) * CASE WHEN i % 3 = 0 THEN -1 ELSE 1 END) END AS v FROM emb),
rep AS (SELECT row_id, repeat, feature, v * (1.0::DOUBLE + ((row_id * 31 + i * 17 + repeat * 13) % 11) / 10.0::DOUBLE) AS v FROM emb, range(3) g(repeat))"""


@query("linear_attributions", with_sql(SQL_FEATURES) + f""", m AS (SELECT avg(coalesce(total, 0)) AS mt, avg(months) AS mm FROM feats)
SELECT row_id, 'total' AS feature, {r('2e-6::DOUBLE * (coalesce(total, 0) - mt)', 'value')} FROM feats, m
UNION ALL SELECT row_id, 'months', round(-0.001::DOUBLE * (months - mm), 8) + 0.0 FROM feats, m""")
def linear_attributions(spark, d):
    f = loan_features(spark, d).na.fill(0.0, ["total"])
    return tidy(explain.linear_attributions(f, {"total": 2e-6, "months": -0.001}))


@query("global_ranking", with_sql(SQL_VALUES) + f""", m AS (SELECT feature, avg(abs(v)) AS a FROM emb GROUP BY feature), k AS (SELECT *, row_number() OVER (ORDER BY a DESC, feature) AS rank FROM m)
SELECT rank, feature, {r('a', 'mean_abs')} FROM k WHERE rank <= 20""")
def global_ranking(spark, d):
    return tidy(explain.global_ranking(main_values(spark, d), []))


@query("additivity_check", with_sql(SQL_VALUES) + f""", s AS (SELECT row_id, sum(v) + 0.25::DOUBLE AS f FROM emb GROUP BY row_id),
g AS (SELECT max(f) > 1 OR min(f) < 0 AS lo FROM s), j AS (SELECT CASE WHEN lo THEN 1 / (1 + exp(-f)) ELSE f END AS f, 1 / (1 + exp(-f)) + (row_id % 5) / 100.0::DOUBLE AS p FROM s, g)
SELECT count(*) AS n, {r('avg(abs(f - p))', 'mae')}, avg(abs(f - p)) < 0.05::DOUBLE AS pass FROM j""")
def additivity_check(spark, d):
    m = main_values(spark, d)
    eta = F.sum("value") + 0.25
    preds = m.groupBy("row_id").agg((1.0 / (1.0 + F.exp(-eta))).alias("_p")).select(
        "row_id", (F.col("_p") + (F.col("row_id") % 5) / 100.0).alias("p")
    )
    return tidy(explain.additivity(m, preds, 0.25))


RANKS = """sh AS (SELECT a.row_id, abs(a.v) AS x, abs(b.v) AS z FROM emb a JOIN loc b USING (row_id, feature) WHERE b.v <> 0),
rk AS (SELECT row_id, rank() OVER (PARTITION BY row_id ORDER BY x) + (count(*) OVER (PARTITION BY row_id, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY row_id ORDER BY z) + (count(*) OVER (PARTITION BY row_id, z) - 1) / 2.0::DOUBLE AS rz FROM sh),
ag AS (SELECT row_id, count(*) AS n_shared, corr(rx, rz) AS rho FROM rk GROUP BY row_id HAVING count(*) >= 3)"""


@query("explanation_agreement", with_sql(SQL_VALUES, RANKS) + "SELECT row_id, n_shared, round_even(rho, 4) AS rho FROM ag")
def explanation_agreement(spark, d):
    return tidy(explain.agreement(main_values(spark, d), local_values(spark, d)))


def _conc(src, name):
    return f"""{name}_o AS (SELECT row_id, abs(v) AS v, row_number() OVER (PARTITION BY row_id ORDER BY abs(v), feature) AS i, sum(abs(v)) OVER (PARTITION BY row_id) AS t,
  sum(abs(v)) OVER (PARTITION BY row_id ORDER BY abs(v) DESC, feature DESC ROWS UNBOUNDED PRECEDING) AS c FROM {src}),
{name} AS (SELECT row_id, CASE WHEN max(t) <= 0 OR count(*) < 2 THEN 0 ELSE (2 * sum(i * v) - (count(*) + 1) * max(t)) / (count(*) * max(t)) END AS gini,
  CASE WHEN max(t) <= 0 THEN count(*) ELSE least(count(*) FILTER (c < 0.8::DOUBLE * t) + 1, count(*)) END AS feats FROM {name}_o GROUP BY row_id)"""


@query("explanation_concentration", with_sql(SQL_VALUES, _conc("loc", "cl")) + f"SELECT row_id, {r('gini', 'gini')}, feats AS features_for_mass FROM cl")
def explanation_concentration(spark, d):
    return tidy(explain.concentration(local_values(spark, d), ["row_id"]))


STABLE = """rr AS (SELECT *, abs(v) AS a, row_number() OVER (PARTITION BY row_id, repeat ORDER BY abs(v) DESC, feature DESC) <= 10 AS hit,
  rank() OVER (PARTITION BY row_id, repeat ORDER BY abs(v)) + (count(*) OVER (PARTITION BY row_id, repeat, abs(v)) - 1) / 2.0::DOUBLE AS rk FROM rep),
pr AS (SELECT a.row_id, a.repeat AS ra, b.repeat AS rb, coalesce(corr(a.rk, b.rk), 0) AS rho,
  count(*) FILTER (a.hit AND b.hit)::DOUBLE / greatest(count(*) FILTER (a.hit OR b.hit), 1) AS jac
  FROM rr a JOIN rr b ON a.row_id = b.row_id AND a.feature = b.feature AND a.repeat < b.repeat GROUP BY ALL),
st AS (SELECT row_id, avg(rho) AS rho, avg(jac) AS jac FROM pr GROUP BY row_id)"""


@query("repeat_stability", with_sql(SQL_VALUES, STABLE) + f"SELECT row_id, {r('rho', 'stability_rho')}, {r('jac', 'top_jaccard')} FROM st")
def repeat_stability(spark, d):
    return tidy(explain.repeat_stability(repeated_values(spark, d), ["row_id"]))


@query("explanation_quality", with_sql(SQL_VALUES, RANKS, STABLE, _conc("emb", "cm"), _conc("loc", "cl")) + f"""SELECT cm.row_id, {r('cm.gini', 'main_gini')}, cm.feats AS main_features,
  {r('cl.gini', 'local_gini')}, cl.feats AS local_features, {r('ag.rho', 'abs_rank_rho')}, {r('st.rho', 'stability_rho')}, {r('st.jac', 'top_jaccard')},
  {r('CASE WHEN label < 5 THEN label / 10.0::DOUBLE END', 'local_r2')}
FROM cm JOIN cl USING (row_id) LEFT JOIN ag USING (row_id) LEFT JOIN st USING (row_id) LEFT JOIN embeddings ON vec_id = cm.row_id""")
def explanation_quality(spark, d):
    fit = table(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("row_id"), (F.col("label") / 10.0).alias("r2"))
    return tidy(explain.quality_table(main_values(spark, d), local_values(spark, d), repeated_values(spark, d), fit))


FID = ["total", "balance", "months", "fold"]


def _fid_inputs(spark, d):
    f = loan_features(spark, d).na.fill(0.0, ["total", "balance"]).withColumn("fold", F.col("fold").cast("double"))
    values = f.select(
        "row_id",
        ((F.col("total") - 200000.0) / 1e5).alias("total"),
        (F.col("balance") / 4000.0).alias("balance"),
        (F.col("months") / 1000.0).alias("months"),
        F.col("fold").alias("fold"),
    ).unpivot(["row_id"], FID, "feature", "value")
    return f, values


def fid_score(df):
    eta = (F.col("total") - 250000.0) / 150000.0 + F.col("balance") / 10000.0 - F.col("months") / 2000.0 + F.col("fold") / 10.0
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-eta)))


SQL_FID = SQL_FEATURES + f""",
ff AS (SELECT row_id, coalesce(total, 0) AS total, coalesce(balance, 0) AS balance, months, fold::DOUBLE AS fold FROM feats),
fb AS (SELECT median(total) AS bt, median(balance) AS bb, median(months) AS bm, (SELECT fold FROM ff GROUP BY fold ORDER BY count(*) DESC, fold LIMIT 1) AS bf FROM ff),
fv AS (SELECT row_id, 'total' AS feature, abs((total - 200000.0::DOUBLE) / 1e5::DOUBLE) AS a FROM ff UNION ALL SELECT row_id, 'balance', abs(balance / 4000.0::DOUBLE) FROM ff
  UNION ALL SELECT row_id, 'months', abs(months / 1000.0::DOUBLE) FROM ff UNION ALL SELECT row_id, 'fold', abs(fold) FROM ff),
ft AS (SELECT row_id, feature AS top FROM fv QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY a DESC, feature DESC) = 1),
fp AS (SELECT row_id, {_eta_sql('total', 'balance', 'months', 'fold')} AS full_p,
  {_eta_sql("CASE WHEN top = 'total' THEN bt ELSE total END", "CASE WHEN top = 'balance' THEN bb ELSE balance END", "CASE WHEN top = 'months' THEN bm ELSE months END", "CASE WHEN top = 'fold' THEN bf ELSE fold END")} AS del_p,
  {_eta_sql("CASE WHEN top = 'total' THEN total ELSE bt END", "CASE WHEN top = 'balance' THEN balance ELSE bb END", "CASE WHEN top = 'months' THEN months ELSE bm END", "CASE WHEN top = 'fold' THEN fold ELSE bf END")} AS ins_p
  FROM ff JOIN ft USING (row_id), fb)"""


@query("explanation_fidelity", with_sql(SQL_FID) + f"""SELECT row_id, {r('abs(full_p - del_p)', 'comprehensiveness')}, {r('abs(full_p - ins_p)', 'sufficiency')}, {r('full_p', 'full_probability')} FROM fp""")
def explanation_fidelity(spark, d):
    from scorelab.operators import prep

    f, values = _fid_inputs(spark, d)
    base = prep.baseline_row(f, ["total", "balance", "months"], ["fold"])
    return tidy(explain.fidelity(f, values, base, FID, fid_score))


@query("importance_comparison", with_sql(SQL_VALUES) + f""", im AS (SELECT 'attribution' AS source, feature, avg(abs(v)) AS value FROM emb GROUP BY feature UNION ALL SELECT 'builtin', feature, max(abs(v)) FROM emb GROUP BY feature),
ir AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, feature) AS rank FROM im)
SELECT source, feature, {r('value', 'value')}, rank, {r('value / max(value) OVER (PARTITION BY source)', 'scaled')} FROM ir WHERE rank <= 15""")
def importance_comparison(spark, d):
    m = main_values(spark, d)
    a = m.groupBy("feature").agg(F.avg(F.abs("value")).alias("value"))
    b = m.groupBy("feature").agg(F.max(F.abs("value")).alias("value"))
    return tidy(explain.importance_comparison(a, b))


@query("describe_columns", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 'mean', 5)}, {r(f'stddev_samp({c})', 'std', 5)}, {r(f'min({c})', 'min', 5)},
  {r(f'quantile_cont({c}, 0.25::DOUBLE)', 'q25', 5)}, {r(f'quantile_cont({c}, 0.5::DOUBLE)', 'q50', 5)}, {r(f'quantile_cont({c}, 0.75::DOUBLE)', 'q75', 5)}, {r(f'max({c})', 'max', 5)} FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_columns(spark, d):
    return tidy(explain.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), digits=5)


SHAP_BASE = {"total": 2e5, "balance": 4e3, "months": 1e3, "fold": 2.0}


def _hybrid_sql(places):
    """The score with the row's value of every feature that ``places`` lets in, else the baseline's."""
    return _eta_sql(*[f"CASE WHEN {places.format(f=f)} THEN {f} ELSE {v!r}::DOUBLE END" for f, v in SHAP_BASE.items()])


SQL_SHAP = with_sql(SQL_FID) + ", dr AS (SELECT row_id, perm, feature, " + _u("42", "row_id", "perm", "feature") + """ AS u
  FROM ff, range(10) g(perm), (VALUES ('total'), ('balance'), ('months'), ('fold')) t(feature)),
od AS (SELECT row_id, perm, feature, row_number() OVER (PARTITION BY row_id, perm ORDER BY u, feature) AS place FROM dr),
pl AS (SELECT row_id, perm, """ + ", ".join(f"max(place) FILTER (feature = '{f}') AS at_{f}" for f in FID) + f""" FROM od GROUP BY ALL),
gn AS (SELECT od.row_id, od.feature, {_hybrid_sql('at_{f} <= place')} - {_hybrid_sql('at_{f} < place')} AS gain FROM od JOIN pl USING (row_id, perm) JOIN ff USING (row_id))
"""


@query("sampled_shapley", SQL_SHAP + f"SELECT row_id, feature, {r('avg(gain)', 'value', 7)} FROM gn GROUP BY ALL")
def sampled_shapley(spark, d):
    return tidy(_sampled(spark, d), value=7)


def _sampled(spark, d):
    f, _ = _fid_inputs(spark, d)
    return explain.shapley_samples(f.select("row_id", *FID), SHAP_BASE, fid_score, method="md5")


@query("shapley_sums_to_score", with_sql(SQL_FID) + f"""SELECT row_id, {r(f"full_p - {_eta_sql('200000.0::DOUBLE', '4000.0::DOUBLE', '1000.0::DOUBLE', '2.0::DOUBLE')}", 'value')} FROM fp""")
def shapley_sums_to_score(spark, d):
    return tidy(_sampled(spark, d).groupBy("row_id").agg(F.sum("value").alias("value")))


LOCAL_MEANS = {"total": 2.5e5, "balance": 4e3, "months": 1e3, "fold": 2.0}
LOCAL_STDS = {"total": 1.4e5, "balance": 3e3, "months": 6e2, "fold": 1.4}


def _solved_sql():
    """Weighted ridge per row: the normal equations, then Gauss-Jordan steps on a 5 x 6 table of columns."""
    terms = ["1.0::DOUBLE", *[f"b_{f}" for f in FID]]
    sums = [f"sum(w * {x} * {y}) + {0.0 if i != j or not i else 1.0}::DOUBLE AS m_{i}_{j}" for i, x in enumerate(terms) for j, y in enumerate(terms)]
    sums += [f"sum(w * {x} * p) AS m_{i}_5" for i, x in enumerate(terms)]
    out, last = [f"n0 AS (SELECT row_id, sum(w * p * p) AS yy, sum(w) AS ww, {', '.join(sums)} FROM sw GROUP BY row_id)"], "n0"
    for step in range(5):
        cells = [
            (f"m_{step}_{j} / m_{step}_{step}" if i == step else f"m_{i}_{j} - m_{i}_{step} * m_{step}_{j} / m_{step}_{step}") + f" AS m_{i}_{j}"
            for i in range(5) for j in range(6)
        ]
        out.append(f"n{step + 1} AS (SELECT row_id, {', '.join(cells)} FROM {last})")
        last = f"n{step + 1}"
    return ",\n".join(out)


SQL_LOCAL = with_sql(SQL_FID) + ", sm AS (SELECT ff.*, m, " + ", ".join(
    f"CASE WHEN m = 0 OR {_u('42', 'row_id', 'm', chr(39) + f + chr(39))} < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b_{f}, "
    f"{LOCAL_MEANS[f]!r}::DOUBLE + {LOCAL_STDS[f]!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_u('42na', 'row_id', 'm', chr(39) + f + chr(39))})) * cos(2.0::DOUBLE * pi() * {_u('42nb', 'row_id', 'm', chr(39) + f + chr(39))}) AS d_{f}"
    for f in FID) + f""" FROM ff, range(200) g(m)),
sw AS (SELECT row_id, {', '.join(f'b_{f}' for f in FID)}, {_eta_sql(*[f'CASE WHEN b_{f} = 1 THEN {f} ELSE d_{f} END' for f in FID])} AS p,
  exp(-(4.0::DOUBLE - {' - '.join(f'b_{f}' for f in FID)}) / (1.5::DOUBLE * 1.5::DOUBLE)) AS w FROM sm),
{_solved_sql()}
"""


@query("local_surrogate", SQL_LOCAL + " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, {r(f'm_{i}_5', 'value', 6)} FROM n5" for i, f in enumerate(FID, 1)))
def local_surrogate(spark, d):
    f, _ = _fid_inputs(spark, d)
    found = explain.local_surrogate(f.select("row_id", *FID), LOCAL_MEANS, LOCAL_STDS, fid_score, method="md5")
    return tidy(found.select("row_id", "feature", "value"), value=6)


# --- cross-run summaries ---------------------------------------------------------------


def run_scores(spark, d):
    li = table(spark, d, "lineitem")
    cutoff = F.year("l_shipdate").cast("string")
    seed = F.col("l_linenumber") % 2
    wide = li.select(
        F.concat_ws("_", cutoff, seed.cast("string")).alias("run_id"),
        cutoff.alias("cutoff"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_discount") * 10.0 + F.col("l_quantity") / 1000.0) / 1.1).alias("disc"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 30000.0)).alias("price"),
        ((F.col("l_quantity") + F.col("l_tax") * 100.0) / 59.0).alias("qty"),
    )
    return wide.unpivot(["run_id", "cutoff", "y"], list(MODELS), "model", "p")


RUN_KEYS = ["run_id", "cutoff", "model"]


def run_metrics(spark, d):
    return metrics.metric_rows(run_scores(spark, d), RUN_KEYS)


SQL_RUNS = """rw AS (SELECT year(l_shipdate)::VARCHAR || '_' || (l_linenumber % 2) AS run_id, year(l_shipdate)::VARCHAR AS cutoff, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  (l_discount * 10.0::DOUBLE + l_quantity / 1000.0::DOUBLE) / 1.1::DOUBLE AS disc, l_extendedprice / (l_extendedprice + 30000.0::DOUBLE) AS price,
  (l_quantity + l_tax * 100.0::DOUBLE) / 59.0::DOUBLE AS qty FROM lineitem),
rx AS (SELECT run_id, cutoff, y, 'disc' AS model, disc AS p FROM rw UNION ALL SELECT run_id, cutoff, y, 'price', price FROM rw UNION ALL SELECT run_id, cutoff, y, 'qty', qty FROM rw),
rcnt AS (SELECT run_id, cutoff, model, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM rx GROUP BY ALL),
rcv AS (SELECT *, coalesce(sum(pos) OVER o, 0) AS pb, coalesce(sum(neg) OVER o, 0) AS nb, sum(pos) OVER a AS np, sum(neg) OVER a AS nn FROM rcnt
  WINDOW o AS (PARTITION BY run_id, cutoff, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY run_id, cutoff, model)),
ram AS (SELECT run_id, cutoff, model, max(np) AS np, max(nn) AS nn, sum(pos * (nb + 0.5::DOUBLE * neg) / (np * nn)) AS auroc, sum(pos / np * (np - pb) / (np - pb + nn - nb)) AS auprc,
  sum(pos * (p - 1) * (p - 1) + neg * p * p) / (max(np) + max(nn)) AS brier, coalesce(sum(pos) FILTER (p >= 0.5::DOUBLE), 0) AS tp, coalesce(sum(neg) FILTER (p >= 0.5::DOUBLE), 0) AS fp FROM rcv GROUP BY ALL),
rmet AS (SELECT run_id, cutoff, model, auroc, auprc, brier, coalesce(2 * tp / nullif(2 * tp + fp + np - tp, 0), 0) AS f1,
  coalesce((tp * (nn - fp) - fp * (np - tp)) / nullif(sqrt((tp + fp) * np * nn * (np - tp + nn - fp)), 0), 0) AS mcc FROM ram),
rlong AS (SELECT run_id, cutoff, model, 'AUROC' AS metric, auroc AS v FROM rmet UNION ALL SELECT run_id, cutoff, model, 'AUPRC', auprc FROM rmet UNION ALL SELECT run_id, cutoff, model, 'F1', f1 FROM rmet
  UNION ALL SELECT run_id, cutoff, model, 'MCC', mcc FROM rmet UNION ALL SELECT run_id, cutoff, model, 'Brier', brier FROM rmet)"""

FIVE = ["AUROC", "AUPRC", "F1", "MCC", "Brier"]


@query("all_run_metrics", with_sql(SQL_RUNS) + f"""SELECT run_id, cutoff, model, {r('auroc', 'AUROC')}, {r('auprc', 'AUPRC')}, {r('f1', 'F1')}, {r('mcc', 'MCC')}, {r('brier', 'Brier')} FROM rmet""")
def all_run_metrics(spark, d):
    return tidy(run_metrics(spark, d).select(*RUN_KEYS, *FIVE))


def _agg(names):
    return ", ".join(f'round_even(avg({c}), 4) AS "{n}_mean", round_even(stddev_samp({c}), 4) AS "{n}_std"' for n, c in names)


PAIRS = [("AUROC", "auroc"), ("AUPRC", "auprc"), ("F1", "f1"), ("MCC", "mcc"), ("Brier", "brier")]


@query("metric_summary", with_sql(SQL_RUNS) + f"SELECT model, {_agg(PAIRS)}, count(*) AS n_runs FROM rmet GROUP BY model")
def metric_summary(spark, d):
    return tidy(summary.metric_summary(run_metrics(spark, d), ["model"], FIVE))


@query("metric_summary_by_strategy", with_sql(SQL_RUNS) + f"""SELECT model, CASE WHEN run_id LIKE '%_0' THEN 'None' ELSE 'ClassWeight' END AS strategy, {_agg(PAIRS)}, count(*) AS n_runs
FROM rmet GROUP BY ALL""")
def metric_summary_by_strategy(spark, d):
    strategy = F.when(F.col("run_id").endswith("_0"), "None").otherwise("ClassWeight")
    return tidy(summary.metric_summary(run_metrics(spark, d).withColumn("strategy", strategy), ["model", "strategy"], FIVE))


def _blocks(spark, d):
    return metrics.long_metrics(run_metrics(spark, d), RUN_KEYS, FIVE)


FRIED = with_sql(SQL_RUNS) + """, fr AS (SELECT metric, run_id, model, rank() OVER (PARTITION BY metric, run_id ORDER BY v DESC) + (count(*) OVER (PARTITION BY metric, run_id, v) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY metric, run_id, v) AS ties FROM rlong),
fa AS (SELECT metric, model, avg(rk) AS ar, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS tie FROM fr GROUP BY ALL),
fs AS (SELECT metric, max(n) AS n, count(*)::DOUBLE AS k, sum(n * n * ar * ar) AS ssb, sum(tie) AS tie FROM fa GROUP BY metric),
fc AS (SELECT metric, n, k, (12 / (n * k * (k + 1)) * ssb - 3 * n * (k + 1)) / (1 - tie / (n * k * (k * k - 1))) AS chi2, 2.343::DOUBLE * sqrt(k * (k + 1) / (6 * n)) AS cd FROM fs)
"""


@query("friedman_nemenyi", FRIED + f"""SELECT metric, model, {r('ar', 'average_rank')}, 'ok' AS status, fc.n::BIGINT AS n_runs, k::BIGINT AS k, {r('chi2', 'friedman_chi2')}, {r('cd', 'nemenyi_cd')},
  {r('exp(-chi2 / 2)', 'friedman_p')} FROM fa JOIN fc USING (metric)""")
def friedman_nemenyi(spark, d):
    return tidy(compare.friedman(_blocks(spark, d), ["metric"], "run_id"))


@query("nemenyi_pairs", FRIED + f"""SELECT metric, a.model AS model_a, b.model AS model_b, {r('abs(a.ar - b.ar)', 'rank_difference')}, abs(a.ar - b.ar) > cd AS significant
FROM fa a JOIN fa b USING (metric) JOIN fc USING (metric) WHERE a.model < b.model""")
def nemenyi_pairs(spark, d):
    return tidy(compare.significant_pairs(compare.friedman(_blocks(spark, d), ["metric"], "run_id"), ["metric"]))


@query("holm_adjusted", FRIED + f""", hp AS (SELECT metric, exp(-chi2 / 2) AS p FROM fc), hs AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS s FROM hp)
SELECT metric, {r('p', 'p')}, {r('max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM hs""")
def holm_adjusted(spark, d):
    f = compare.friedman(_blocks(spark, d), ["metric"], "run_id")
    one = f.groupBy("metric").agg(F.max("friedman_p").alias("p")).withColumn("family", F.lit("metrics"))
    return tidy(compare.holm(one, ["family"], "p", "p_holm").drop("family"))


@query("descriptive_ranks", with_sql(SQL_RUNS) + f""", dm AS (SELECT metric, cutoff, model, avg(CASE WHEN metric = 'Brier' THEN -v ELSE v END) AS v FROM rlong GROUP BY ALL),
dr AS (SELECT metric, cutoff, model, rank() OVER (PARTITION BY metric, cutoff ORDER BY v DESC) + (count(*) OVER (PARTITION BY metric, cutoff, v) - 1) / 2.0::DOUBLE AS rk FROM dm)
SELECT metric, model, {r('avg(rk)', 'average_rank')}, count(*) AS n_blocks FROM dr GROUP BY ALL""")
def descriptive_ranks(spark, d):
    return tidy(compare.descriptive_ranks(_blocks(spark, d), "cutoff"))


@query("spearman_by_group", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 8) + 0.0 AS rho FROM r GROUP BY l_returnflag""")
def spearman_by_group(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return tidy(compare.spearman_large(li, ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("average_ranks", """SELECT l_returnflag, l_orderkey, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank
FROM lineitem""")
def average_ranks(spark, d):
    from scorelab.operators.ordering import average_ranks as ranks

    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    return tidy(ranks(li, ["l_returnflag"], "l_quantity"))


@query("champion_model", with_sql(SQL_RUNS) + f"""SELECT run_id, model, {r('auroc', 'AUROC')} FROM rmet
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY auroc DESC, list_position(['price', 'disc', 'qty'], model)) = 1""")
def champion_model(spark, d):
    return tidy(summary.best_by_metric(run_metrics(spark, d), ["run_id"], "model", "AUROC", ["price", "disc", "qty"]))


@query("strategy_choice", with_sql(SQL_RUNS) + f""", sr AS (SELECT model, CASE WHEN run_id LIKE '%_0' THEN 'None' ELSE 'ClassWeight' END AS strategy, avg(auroc) AS auroc FROM rmet GROUP BY ALL)
SELECT model, strategy, {r('auroc', 'AUROC')} FROM sr QUALIFY row_number() OVER (PARTITION BY model ORDER BY auroc DESC, list_position(['None', 'ClassWeight'], strategy)) = 1""")
def strategy_choice(spark, d):
    strategy = F.when(F.col("run_id").endswith("_0"), "None").otherwise("ClassWeight")
    by = run_metrics(spark, d).groupBy("model", strategy.alias("strategy")).agg(F.avg("AUROC").alias("AUROC"))
    return tidy(summary.best_by_metric(by, ["model"], "strategy", "AUROC", ["None", "ClassWeight"]))


def _manifests(spark, d):
    o = table(spark, d, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    return o.groupBy(month.alias("run_id")).agg(
        (F.count(F.lit(1)) % 3).cast("string").alias("protocol"),
        F.when(F.count_if(F.col("o_orderstatus") == "F") % 2 == 0, F.lit("f1")).alias("criterion"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("compatible_runs", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, (count(*) % 3)::VARCHAR AS protocol,
  CASE WHEN count(*) FILTER (o_orderstatus = 'F') % 2 = 0 THEN 'f1' END AS criterion, count(*) AS rows FROM orders GROUP BY 1),
cur AS (SELECT run_id, protocol, criterion, -rows AS rows FROM m WHERE run_id >= '2001-01'), ref AS (SELECT * FROM cur WHERE run_id = '2001-01')
SELECT * FROM cur UNION ALL SELECT m.* FROM m JOIN ref ON m.protocol IS NOT DISTINCT FROM ref.protocol AND m.criterion IS NOT DISTINCT FROM ref.criterion
WHERE m.run_id NOT IN (SELECT run_id FROM cur)""")
def compatible_runs(spark, d):
    m = _manifests(spark, d)
    current = m.where(F.col("run_id") >= "2001-01").withColumn("rows", -F.col("rows"))
    return tidy(summary.compatible_runs(m, current, ["protocol", "criterion"], "2001-01"))


@query("stacked_tables", """SELECT 'orders' AS run_id, o_orderstatus AS model, count(*) AS n, NULL::DOUBLE AS mean FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'lines', l_returnflag, count(*), round(avg(l_quantity), 8) FROM lineitem GROUP BY l_returnflag""")
def stacked_tables(spark, d):
    a = table(spark, d, "orders").groupBy(F.lit("orders").alias("run_id"), F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "lineitem").groupBy(F.lit("lines").alias("run_id"), F.col("l_returnflag").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"))
    return tidy(summary.stack_tables([a, b]))


@query("still_to_fit", """SELECT DISTINCT o_custkey % 50 || '/' || o_orderpriority AS recipe FROM orders
WHERE o_custkey % 50 || '/' || o_orderpriority NOT IN (SELECT o_custkey % 50 || '/' || o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01')""")
def still_to_fit(spark, d):
    o = table(spark, d, "orders").withColumn(
        "recipe", F.concat_ws("/", (F.col("o_custkey") % 50).cast("string"), "o_orderpriority")
    )
    saved = o.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp"))
    return summary.still_to_fit(o.select("recipe"), saved)


@query("fidelity_merge", with_sql(SQL_VALUES, _conc("emb", "cm")) + f"""SELECT row_id, {r('gini', 'gini')}, label::BIGINT AS comprehensiveness
FROM cm LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE label > 3) ON vec_id = row_id""")
def fidelity_merge(spark, d):
    q = explain.concentration(main_values(spark, d), ["row_id"]).select("row_id", "gini")
    e = table(spark, d, "embeddings").where("label > 3").select(F.col("vec_id").alias("row_id"), F.col("label").alias("comprehensiveness"))
    return tidy(summary.with_fidelity(q, e))


def _saved_quality(spark, d):
    rho = explain.agreement(main_values(spark, d), local_values(spark, d), digits=None)
    signed = F.col("rho") * F.when(F.col("row_id") % 3 == 0, -1.0).otherwise(1.0)
    return rho.select("row_id", F.abs("rho").alias("abs_rank_rho"), signed.alias("signed_rank_rho"))


@query("repaired_agreement", with_sql(SQL_VALUES, RANKS) + f"""SELECT row_id, {r('rho * CASE WHEN row_id % 3 = 0 THEN -1 ELSE 1 END', 'abs_rank_rho')}, {r('rho * CASE WHEN row_id % 3 = 0 THEN -1 ELSE 1 END', 'signed_rank_rho')} FROM ag""")
def repaired_agreement(spark, d):
    return tidy(summary.repair_agreement(_saved_quality(spark, d)))


@query("repaired_count", with_sql(SQL_VALUES, RANKS) + "SELECT count(*) FILTER (rho * CASE WHEN row_id % 3 = 0 THEN -1 ELSE 1 END < 0) AS rows_changed, count(*) AS rows FROM ag")
def repaired_count(spark, d):
    return tidy(summary.repaired_count(_saved_quality(spark, d)))


@query("tagged_bootstrap", f"""SELECT o_orderpriority AS model, {r('avg(o_totalprice)', 'estimate', 4)}, '{summary.BOOTSTRAP_SCOPE}' AS inference_scope FROM orders GROUP BY 1""")
def tagged_bootstrap(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("estimate"))
    return tidy(summary.tag_bootstrap(t), digits=4)

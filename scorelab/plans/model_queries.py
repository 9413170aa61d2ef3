"""Queries that fit Spark ML models on the labelled loans and other case tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.operators import boosting, compare, explain, metrics, prep, resample, robust, scoring, summary, tree_values
from scorelab.plans.base import SQL_SCORES, query, r, scores, table, tidy, with_sql
from scorelab.plans.data_queries import CUTOFFS, SQL_FEATURES, SQL_FORWARD, loan_features, periods
from scorelab.operators.features import period_features
from scorelab.plans.metric_queries import SQL_CURVE
from scorelab.session import materialised, scratch_path, stored
from scorelab.sources import sinks

ROLES = scoring.Roles(("total", "balance", "months"), ("total", "balance"), ("segment", "priority"))


def recipe(family, strategy="None", **params):
    return scoring.Recipe(family, strategy, 42, params)


def dated(features: DataFrame) -> DataFrame:
    return features.withColumn("observable_by", F.col("orig") + F.make_interval(months=F.lit(12)))


def temporal(spark, d, cutoff: str, features: DataFrame | None = None):
    """Train: label known by the cutoff (a month); test: the half year after it. ``features``: the dated loans, if they are there already."""
    at = F.lit(f"{cutoff}-01").cast("timestamp")
    f = dated(loan_features(spark, d)) if features is None else features
    train = F.col("observable_by") <= at
    test = (F.col("orig") >= at) & (F.col("orig") < at + F.make_interval(months=F.lit(6)))
    return f.where(train | test), train, test


def per_cutoff(spark, d, judged: Callable[[scoring.Prepared, Column, Column], DataFrame], folds=None, finals=(), at_once: int = 1) -> DataFrame:
    """The results of ``judged(prepared, train, test)`` for every cutoff; the loans are read and joined once, tables are prepared side by side.

    The final fits of the recipes ``finals`` are one plan for all cutoffs. ``at_once`` cutoffs are judged at the same time.
    """
    features = stored(dated(loan_features(spark, d)), "loans")
    cut = {c: temporal(spark, d, c, features) for c in CUTOFFS}
    # without folds the statistics of all cutoffs are one sort
    stats = scoring.statistics_of(features, ROLES, {c: train for c, (_, train, _) in cut.items()}) if folds is None else {}

    def prepared(cutoff):
        rows, train, test = cut[cutoff]
        return scoring.prepare(rows, ROLES, folds, train, stats.get(cutoff)), train, test

    parts = scoring.side_by_side([lambda c=c: prepared(c) for c in CUTOFFS])
    scoring.fit_together([(p, recipe, train) for p, train, _ in parts for recipe in finals])
    tables = [lambda c=c, x=x: materialised(judged(*x).select(F.lit(c).alias("cutoff"), "*")) for c, x in zip(CUTOFFS, parts)]
    return summary.stack_tables(scoring.side_by_side(tables, at_once))


@query("oof_scores")
def oof_scores(spark, d):
    folds = scoring.Folds.partition("fold", 5)
    p = scoring.prepare(loan_features(spark, d), ROLES, folds)
    return scoring.oof_scores(p, folds, recipe("logistic"))


@query("oof_coverage", with_sql(SQL_FEATURES) + "SELECT 'fold' || fold AS fold, count(*) AS n, sum(y)::BIGINT AS positives FROM feats GROUP BY fold")
def oof_coverage(spark, d):
    """Every row is scored once, by the model that did not see it."""
    s = oof_scores(spark, d)
    ok = F.col("p").isNotNull() & (F.col("p") > 0) & (F.col("p") < 1)
    return tidy(s.where(ok).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")))


@query("oof_coverage_forward", with_sql(SQL_FORWARD) + """SELECT 'fold' || fold AS fold, count(*) AS n, sum(y)::BIGINT AS positives
FROM avail JOIN folds USING (month) WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = row_id) GROUP BY fold""")
def oof_coverage_forward(spark, d):
    """Month-disjoint folds: early rows stay uncovered and are absent."""
    f = loan_features(spark, d).withColumn("observable_by", F.col("orig") + F.make_interval(months=F.lit(12)))
    flagged = scoring.with_forward_flags(f)
    folds = scoring.Folds.from_flags(3)
    s = scoring.oof_scores(scoring.prepare(flagged, ROLES, folds), folds, recipe("logistic"))
    return tidy(s.where("p IS NOT NULL").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")))


@query("fold_metrics")
def fold_metrics(spark, d):
    return scoring.fold_summary(scoring.fold_metrics(oof_scores(spark, d)))


def _family(name):
    def run(spark, d):
        wanted = recipe(name, "ClassWeight")

        def judged(p, train, test):
            _, scored = scoring.final_scores(p, wanted, train, test)
            return metrics.metric_rows(scored.withColumn("model", F.lit(name)), ["model"], 0.5)

        return per_cutoff(spark, d, judged, finals=[wanted])

    return run


for _name in scoring.FAMILY_ORDER:
    query(f"family_{_name}")(_family(_name))


@query("feature_importances")
def feature_importances(spark, d):
    def judged(p, train, test):
        model, _ = scoring.final_scores(p, recipe("forest"), train, test)
        return explain.global_ranking(spark.createDataFrame(model.importances(), "feature string, value double"), [])

    return per_cutoff(spark, d, judged, finals=[recipe("forest")])


@query("random_search")
def random_search(spark, d):
    folds = scoring.Folds.partition("fold", 5)
    p = scoring.prepare(loan_features(spark, d), ROLES, folds)
    draws = {name: scoring.draw_params(name, 12, 42) for name in scoring.FAMILY_ORDER}
    return scoring.search_plan(p, folds, [recipe(name) for name in scoring.FAMILY_ORDER], draws)


@query("plan_sizes", with_sql(SQL_FEATURES) + """SELECT recipe, 'fold' || fold AS fold, count(*) AS n, sum(y)::BIGINT AS positives, true AS scored
FROM feats, (VALUES ('logistic 1'), ('logistic 0.1'), ('boost'), ('weighted boost')) t(recipe) GROUP BY ALL""")
def plan_sizes(spark, d):
    """Several recipes in one plan: each scores every row once, in the fold that holds it out."""
    folds = scoring.Folds.partition("fold", 5)
    p = scoring.prepare(loan_features(spark, d), ROLES, folds)
    small = {"rounds": 8, "depth": 3, "rate": 0.3}
    recipes = {"logistic 1": recipe("logistic", maxIter=10), "logistic 0.1": recipe("logistic", C=0.1, maxIter=10),
               "boost": recipe("boost_plain", **small), "weighted boost": recipe("boost_gain", "ClassWeight", **small)}
    s = scoring.oof_plan(p, folds, recipes)
    ok = F.min((F.col("p") > 0) & (F.col("p") < 1)).alias("scored")
    return tidy(s.groupBy("recipe", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), ok))


@query("strategy_ablation")
def strategy_ablation(spark, d):
    folds = scoring.Folds.partition("fold", 5)

    def judged(p, train, test):
        return scoring.strategy_ablation(p, folds, [recipe("logistic"), recipe("forest")], list(resample.STRATEGIES), train, test)

    return per_cutoff(spark, d, judged, folds, at_once=len(CUTOFFS))


@query("one_hot_columns", with_sql(SQL_FEATURES) + """, long AS (SELECT fold, 'segment' AS feature, segment AS level FROM feats UNION ALL SELECT fold, 'priority', priority FROM feats),
words AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS slot FROM (SELECT DISTINCT feature, level FROM long WHERE fold <> 0 AND level IS NOT NULL))
SELECT feature, slot::BIGINT AS slot, count(*) AS ones FROM words JOIN long USING (feature, level) GROUP BY ALL""")
def one_hot_columns(spark, d):
    """Indicator columns of the training levels over all rows; unseen and missing levels set none of them."""
    p = scoring.prepare(loan_features(spark, d), ROLES, None, F.col("fold") != 0)
    ready = scoring._tagged(p.rows, ROLES, p.levels)
    names = [f"hot_{c}" for c in ROLES.nominals]
    hot = OneHotEncoder(inputCols=list(ROLES.nominals), outputCols=names, dropLast=True, handleInvalid="error").fit(ready).transform(ready)
    parts = [hot.select(F.lit(c).alias("feature"), F.posexplode(vector_to_array(n)).alias("slot", "one")) for c, n in zip(ROLES.nominals, names)]
    return tidy(parts[0].union(parts[1]).where("one > 0").groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("ones")))


# --- boosting, one tree that SQL can follow ---------------------------------------

TREE_INPUTS = {"total0": "coalesce(total, 0)", "balance0": "coalesce(balance, 0)", "months": "months"}
FIRST = boosting.Settings("level", rounds=1, depth=2, rate=0.05, gamma=0.1, alpha=0.1, l2=1.0, min_hessian=1.0)


def _quality_sql(n, ys):
    return f"pow(greatest(abs({n} * p - {ys}) - {FIRST.alpha}::DOUBLE, 0), 2) / ({n} * p * (1 - p) + {FIRST.l2}::DOUBLE)"


def _level_sql(name, rows):
    """The best cut of every path of ``rows`` (row_id, y, path): all cuts of all features are tried."""
    return f"""{name}_c AS (SELECT path, feature, e, count(*) FILTER (v <= e) AS nl, coalesce(sum(y) FILTER (v <= e), 0) AS yl, count(*) AS n, sum(y) AS ys
  FROM {rows} JOIN x USING (row_id) JOIN edges USING (feature) GROUP BY ALL),
{name}_g AS (SELECT *, 0.5::DOUBLE * ({_quality_sql('nl', 'yl')} + {_quality_sql('(n - nl)', '(ys - yl)')} - {_quality_sql('n', 'ys')}) - {FIRST.gamma}::DOUBLE AS gain
  FROM {name}_c, share WHERE least(nl, n - nl) * p * (1 - p) >= {FIRST.min_hessian}::DOUBLE),
{name} AS (SELECT path, feature, e, gain, n FROM {name}_g WHERE gain > 1e-12::DOUBLE QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(gain, 7) DESC, feature, e) = 1),
{name}_to AS (SELECT row_id, {rows}.y, path || CASE WHEN v <= e THEN 'L' ELSE 'R' END AS path FROM {rows} JOIN {name} USING (path) JOIN x USING (row_id, feature))"""


SQL_TREE = with_sql(SQL_FEATURES) + ", x AS (" + " UNION ALL ".join(
    f"SELECT row_id, {i} AS feature, ({e})::DOUBLE AS v FROM feats" for i, e in enumerate(TREE_INPUTS.values())
) + f"""), share AS (SELECT avg(y)::DOUBLE AS p FROM feats),
edges AS (SELECT DISTINCT feature, unnest(quantile_cont(v, [{', '.join(f'{i / 64!r}' for i in range(1, 64))}])) AS e FROM x GROUP BY feature),
top AS (SELECT row_id, y, '' AS path FROM feats),
{_level_sql('one', 'top')},
{_level_sql('two', 'one_to')},
leaf AS (SELECT path, n, ys FROM (SELECT path, count(*) AS n, sum(y) AS ys FROM (
    SELECT path, y FROM two_to UNION ALL SELECT path, y FROM one_to WHERE path NOT IN (SELECT path FROM two) UNION ALL SELECT path, y FROM top WHERE path NOT IN (SELECT path FROM one)) GROUP BY path)),
tree AS (
  SELECT path, feature, e, gain, n, NULL::DOUBLE AS value FROM one UNION ALL SELECT path, feature, e, gain, n, NULL FROM two
  UNION ALL SELECT path, NULL, NULL, NULL, n, -{FIRST.rate}::DOUBLE * sign(n * p - ys) * greatest(abs(n * p - ys) - {FIRST.alpha}::DOUBLE, 0) / (n * p * (1 - p) + {FIRST.l2}::DOUBLE) FROM leaf, share)
"""


def _first_tree(spark, d):
    rows = stored(loan_features(spark, d).select(F.col("row_id").cast("string").alias("id"), "row_id", "y", *[F.expr(e).cast("double").alias(n) for n, e in TREE_INPUTS.items()]), "loans")
    model = boosting.fit_many([boosting.row_set(rows, "all")], list(TREE_INPUTS), [boosting.Fit("first", "all", FIRST)])["first"]
    return rows, model


@query("boost_first_tree", SQL_TREE + f"""SELECT path, {{0: 'total0', 1: 'balance0', 2: 'months'}}[feature] AS feature,
  {r('e', 'threshold', 5)}, {r('gain', 'gain', 5)}, n::BIGINT AS cover, {r('value', 'value', 7)} FROM tree""".replace(
    "{0: 'total0', 1: 'balance0', 2: 'months'}[feature]", "CASE feature WHEN 0 THEN 'total0' WHEN 1 THEN 'balance0' WHEN 2 THEN 'months' END"))
def boost_first_tree(spark, d):
    """The splits, gains and leaf values of a first tree."""
    _, model = _first_tree(spark, d)
    t = model.trees[0]
    out, open_ = [], [(0, "")]
    while open_:
        at, path = open_.pop()
        f = int(t.feature[at])
        if f < 0:
            out.append((path, None, None, None, int(t.cover[at]), float(t.value[at])))
            continue
        out.append((path, model.features[f], float(model.edges[f][t.cut[at]]), float(t.gain[at]), int(t.cover[at]), None))
        open_ += [(int(t.left[at]), path + "L"), (int(t.right[at]), path + "R")]
    schema = "path string, feature string, threshold double, gain double, cover long, value double"
    return tidy(spark.createDataFrame(out, schema), threshold=5, gain=5, value=7)


def _path_sum(i: int) -> str:
    """Shapley value of feature ``i`` of the two-level tree: subsets are listed one by one."""
    terms = []
    for subset in range(8):
        if subset >> i & 1:
            continue
        size = bin(subset).count("1")
        share = (2, 1, 2)[size] / 6.0  # s! (3 - s - 1)! / 3!
        terms.append(f"{share!r}::DOUBLE * (v{subset | 1 << i} - v{subset})")
    return " + ".join(terms)


SQL_PATHS = SQL_TREE + """, nd AS (SELECT path, feature, e, n FROM tree WHERE feature IS NOT NULL), lf AS (SELECT path, n, value FROM tree WHERE feature IS NULL),
hops AS (SELECT lf.path AS leaf, lf.value, nd.feature, nd.e, substr(lf.path, length(nd.path) + 1, 1) = 'L' AS down,
    (SELECT t.n FROM tree t WHERE t.path = substr(lf.path, 1, length(nd.path) + 1)) / nd.n::DOUBLE AS part
  FROM lf JOIN nd ON starts_with(lf.path, nd.path) AND length(nd.path) < length(lf.path)),
met AS (SELECT row_id, leaf, hops.value, hops.feature, CASE WHEN (x.v <= e) = down THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, part FROM hops JOIN x USING (feature)),
per AS (SELECT row_id, leaf, value, """ + ", ".join(
    f"product(CASE WHEN {' OR '.join(f'feature = {f}' for f in range(3) if s >> f & 1) or 'false'} THEN o ELSE part END) AS w{s}" for s in range(8)
) + " FROM met GROUP BY row_id, leaf, value), vals AS (SELECT row_id, " + ", ".join(f"sum(value * w{s}) AS v{s}" for s in range(8)) + " FROM per GROUP BY row_id)\n"


@query("tree_attributions", SQL_PATHS + " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS feature, {r(_path_sum(i), 'value', 7)} FROM vals" for i, n in enumerate(TREE_INPUTS)))
def tree_attributions(spark, d):
    """Exact attributions of that tree for every loan; the SQL lists all subsets of features."""
    rows, model = _first_tree(spark, d)
    return tidy(tree_values.tree_values(rows, tree_values.boosted_leaves(model), model.features), value=7)


@query("forest_additivity", with_sql(SQL_FEATURES) + "SELECT count(*) AS n, true AS exact FROM feats")
def forest_additivity(spark, d):
    """Attributions of a forest sum to its probability less the expected one, for every loan."""
    p = scoring.prepare(loan_features(spark, d), ROLES, None)
    model, scored = scoring.final_scores(p, recipe("forest", numTrees=20, maxDepth=6), F.lit(True), F.lit(True))
    table = tree_values.forest_leaves(model.model.stages[-1])
    parts = tree_values.tree_values(p.view("all", F.lit(True)), table, ROLES.inputs).groupBy("row_id").agg(F.sum("value").alias("v"))
    off = F.abs(F.col("v") + F.lit(tree_values.expected(table)) - F.col("p"))
    return parts.join(scored, "row_id").agg(F.count(F.lit(1)).alias("n"), (F.max(off) < 1e-9).alias("exact"))


@query("boost_stops", with_sql(SQL_FEATURES) + "SELECT growth, true AS stops_early, true AS keeps_best FROM (VALUES ('leaf'), ('level'), ('symmetric')) t(growth)")
def boost_stops(spark, d):
    """Each way of growing stops once its held rows rank no better, and keeps its best round."""
    rows = loan_features(spark, d).select(F.col("row_id").cast("string").alias("id"), "y", (F.col("row_id") % 7 == 0).alias("_stop"),
                                          *[F.expr(e).cast("double").alias(n) for n, e in TREE_INPUTS.items()])
    ways = {g: boosting.Settings(g, rounds=400, depth=3, rate=0.3, leaves=6, patience=5) for g in ("leaf", "level", "symmetric")}
    models = boosting.fit_many([boosting.row_set(stored(rows, "loans"), "all")], list(TREE_INPUTS), [boosting.Fit(g, "all", w) for g, w in ways.items()])
    out = [(g, m.rounds < 400, len(m.trees) == m.rounds - 5 and max(m.history) == m.history[len(m.trees) - 1]) for g, m in models.items()]
    return spark.createDataFrame(out, "growth string, stops_early boolean, keeps_best boolean")


@query("fit_store", with_sql(SQL_FEATURES) + ", k AS (SELECT count(DISTINCT fold)::BIGINT AS k, count(*)::BIGINT AS n FROM feats)\n" + " UNION ALL ".join(
    f"SELECT '{step}' AS step, {fits} AS fits, n AS scores FROM k" for step, fits in (("first run", "k"), ("same again", "0"), ("one fold missing", "1"), ("other parameter", "k"), ("one row changed", "k"))))
def fit_store(spark, d):
    """Scores are fitted once per recipe, rows and fold; only what is missing is fitted again."""
    folds, f = scoring.Folds.partition("fold", 5), loan_features(spark, d)
    one = f.agg(F.min("row_id")).first()[0]
    changed = f.withColumn("total", F.when(F.col("row_id") == one, 1.0).otherwise(F.col("total")))
    root, out = scratch_path(spark, "fit-store"), []
    plain, other = {"a": recipe("logistic", maxIter=10)}, {"a": recipe("logistic", maxIter=11)}
    p = scoring.prepare(f, ROLES, folds)
    for step, prepared, wanted in (("first run", p, plain), ("same again", p, plain), ("one fold missing", p, plain), ("other parameter", p, other), ("one row changed", scoring.prepare(changed, ROLES, folds), plain)):
        if step == "one fold missing":
            sinks.retract_runs(spark, root, [scoring.store_key(wanted["a"], "fold3", scoring.table_key(prepared))])
        scores, fitted = scoring.oof_from_store(prepared, folds, wanted, root)
        out.append((step, len(fitted), scores.count()))
    return spark.createDataFrame(out, "step string, fits long, scores long")


RULES = with_sql(SQL_SCORES, SQL_CURVE) + """, grid AS (SELECT i, 0.01::DOUBLE + i * 0.01::DOUBLE AS t FROM range(98) g(i)),
pt AS (SELECT model, i, t, coalesce(sum(pos) FILTER (p >= t), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (p >= t), 0)::DOUBLE AS fp, sum(pos)::DOUBLE AS np FROM counts, grid WHERE run_id = 'run_F' GROUP BY ALL),
ps AS (SELECT *, tp / (tp + fp + 1e-10::DOUBLE) AS prec, tp / (np + 1e-10::DOUBLE) AS sens FROM pt),
tuned AS (SELECT model, t FROM ps QUALIFY row_number() OVER (PARTITION BY model ORDER BY 2.0::DOUBLE * prec * sens / (prec + sens + 1e-10::DOUBLE) DESC, i) = 1),
arms AS (SELECT model, 'oof_f1' AS threshold_rule, t FROM tuned UNION ALL SELECT model, 'fixed_0.50', 0.5::DOUBLE FROM tuned),
hd AS (SELECT model, threshold_rule, t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p < t AND y = 0) AS tn
  FROM scores JOIN arms USING (model) WHERE run_id = 'run_O' GROUP BY ALL)
"""


def _arms(spark, d):
    s = scores(spark, d)
    return [s.where(F.col("run_id") == x).drop("run_id") for x in ("run_F", "run_O")]


@query("threshold_rules", RULES + f"""SELECT model, threshold_rule, {r('t', 'threshold')}, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN",
  {r('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 'F1')} FROM hd""")
def threshold_rules(spark, d):
    out = scoring.threshold_rules(*_arms(spark, d), ["model"])
    return tidy(out.select("model", "threshold_rule", "threshold", "TP", "FP", "FN", "TN", "F1"))


@query("controlled_ablation")
def controlled_ablation(spark, d):
    return scoring.controlled_ablation(*_arms(spark, d), "model")


@query("feature_ablation")
def feature_ablation(spark, d):
    """Raw yearly blocks against the engineered features, predicting a negative account balance."""
    six = [[f"{x}_{i}" for i in range(6)] for x in ("bill", "pay", "late")]
    made = ["util_rate_mean", "pay_ratio_mean", "avg_pay_delay", "max_pay_delay", "bill_trend", "pay_trend", "limit_ratio", "delay_spike"]
    base = periods(spark, d).withColumn("y", (F.col("credit_limit") < 0).cast("int")).withColumn("credit_limit", F.lit(1000.0))
    rows = period_features(base, "credit_limit", *six).withColumn("row_id", F.col("c_custkey"))
    rows = rows.withColumns({"part": F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"), "fold": F.col("row_id") % 5})
    train, test = F.col("part") == "train", F.col("part") == "test"
    folds = scoring.Folds.partition("fold", 5)
    raw = tuple(c for block in six for c in block)
    sets = {"raw_features": scoring.Roles(raw), "engineered_features": scoring.Roles((*raw, *made))}
    rows = materialised(rows)
    prepared = dict(zip(sets, scoring.side_by_side([lambda v=v: scoring.prepare(rows, v, folds, train) for v in sets.values()])))

    def judged(name):
        return scoring.feature_ablation(prepared, folds, recipe(name), train, test).select(F.lit(name).alias("model"), "*")

    boosts = [n for n in scoring.FAMILY_ORDER if n.startswith("boost")]
    first = [judged(n) for n in scoring.FAMILY_ORDER if n not in boosts]  # they make the training sets of all
    return summary.stack_tables([*first, *scoring.side_by_side([lambda n=n: judged(n) for n in boosts])])


@query("external_validation")
def external_validation(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("length"), "lang"
    )
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") < 0).cast("int").alias("y"),
        F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )
    sets = {
        "documents": (docs, scoring.Roles(("length",), (), ("lang",))),
        "customers": (cust, scoring.Roles(("nation",), (), ("segment",))),
        "broken": (cust, scoring.Roles(("no_such_column",))),
    }
    return scoring.external_validation(sets, [recipe("logistic"), recipe("boost_plain")], k=5)


@query("model_robustness")
def model_robustness(spark, d):
    """A fitted forest rescored under all perturbations of the raw features."""
    def judged(p, train, test):
        model, _ = scoring.final_scores(p, recipe("forest"), train, test)

        def score(df):
            kept = df.withColumn("fit", F.lit("all"))
            others = [c for c in df.columns if c not in ROLES.inputs and c not in ("row_id", "y")]
            ready = prep.apply_statistics(kept, p.stats, ROLES.continuous, ROLES.indicators, ROLES.nominals,
                                          keep=["row_id", "y", *others, *[F.col(c).alias(f"_raw_{c}") for c in ROLES.continuous]])
            out = model(ready)
            return out.select("row_id", "y", *others, *[F.col(f"_raw_{c}").alias(c) for c in ROLES.continuous], *ROLES.nominals, "p")

        profile = robust.train_profile(p.rows.where(train), ROLES.continuous)
        held = p.rows.where(test).select("row_id", "y", *ROLES.continuous, *ROLES.nominals)
        return robust.robustness_table(held, profile, ROLES.continuous, score, 0.3, 42, protected=ROLES.nominals, method="xxhash64")

    return per_cutoff(spark, d, judged, finals=[recipe("forest")])


@query("model_comparison")
def model_comparison(spark, d):
    """Two families on the same test rows: DeLong, McNemar and Holm in one table."""
    names = ("logistic", "forest")

    def judged(p, train, test):
        parts = []
        for name in names:
            _, s = scoring.final_scores(p, recipe(name), train, test)
            parts.append(s.select(F.lit("loans").alias("run_id"), F.lit(name).alias("model"), "row_id", "y", "p"))
        both = parts[0].unionByName(parts[1])
        return compare.pairwise_matrix(both, ["run_id"], 0.3)

    return per_cutoff(spark, d, judged, finals=[recipe(name) for name in names])

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.functions.grids import FAIRNESS, SWEEP, TUNING, Grid
from scorelab.operators import calibrate, compare, fairness, metrics, thresholds


def rows_of(df, key="model"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_fixture_metrics(spark, fixture_scores):
    m = rows_of(metrics.metric_rows(fixture_scores, ["model"]))
    assert m["a"]["AUROC"] == pytest.approx(0.9) and m["b"]["AUROC"] == pytest.approx(0.8666666667)
    assert m["a"]["AUPRC"] == pytest.approx(0.8666666667) and m["b"]["AUPRC"] == pytest.approx(0.8666666667)
    assert m["a"]["Brier"] == pytest.approx(0.15) and m["b"]["Brier"] == pytest.approx(0.1721875)
    assert (m["a"]["TP"], m["a"]["FP"], m["a"]["FN"], m["a"]["TN"]) == (2, 1, 1, 4)
    assert m["a"]["F1"] == pytest.approx(2 / 3) and m["a"]["MCC"] == pytest.approx(0.4666666667)


def test_average_precision_is_stepwise(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.35), (4, 1, 0.8)], "row_id long, y int, p double")
    assert metrics.ranking_metrics(df, []).first()["AUPRC"] == pytest.approx(0.8333333333)


def test_one_class_has_no_auroc_and_zero_counts(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4)], "row_id long, y int, p double")
    r = metrics.metric_rows(df, [], 0.5).first()
    assert r["AUROC"] is None and (r["TP"], r["FP"], r["FN"], r["TN"]) == (0, 0, 0, 0)


def test_metrics_with_many_chunks_match_brute_force(many_partitions):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    p = np.round(np.clip(0.3 * y + 0.7 * rng.random(3000), 0, 1), 3)
    df = many_partitions.createDataFrame(list(zip(range(3000), y.tolist(), p.tolist())), "row_id long, y int, p double")
    got = metrics.ranking_metrics(df, []).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert got["AUROC"] == pytest.approx(auc, abs=1e-12)


@pytest.mark.parametrize("grid,args", [(TUNING, (0.01, 0.99, 0.01)), (SWEEP, (0.05, 0.95, 0.01)), (FAIRNESS, (0.20, 0.61, 0.05))])
def test_grids_are_the_arange_doubles(spark, grid, args):
    assert grid.values() == np.arange(*args).tolist()
    points = [v for x in grid.values() for v in (x, np.nextafter(x, 0), np.nextafter(x, 1))] + [0.0, 1.0]
    df = spark.createDataFrame([(float(v),) for v in points], "p double")
    for r in df.select("p", grid.slot(F.col("p")).alias("s")).collect():
        assert r["s"] == sum(g <= r["p"] for g in grid.values())


def test_grid_edges_of_bins(spark):
    assert Grid.inner_edges(10).values() == np.linspace(0, 1, 11)[1:-1].tolist()


def test_best_thresholds(spark, fixture_scores):
    best = {r["model"]: r for r in thresholds.optimal_thresholds(fixture_scores, ["model"], ["f1"]).collect()}
    assert best["a"]["threshold"] == 0.7000000000000001 and best["a"]["score"] == pytest.approx(0.8)
    assert best["b"]["threshold"] == pytest.approx(0.51)


def test_unknown_criterion(fixture_scores):
    with pytest.raises(ValueError):
        thresholds.optimal_thresholds(fixture_scores, ["model"], ["accuracy"])


def test_calibration_fixture(spark, fixture_scores):
    c = rows_of(calibrate.calibration_summary(fixture_scores, ["model"]))
    assert c["a"]["ece"] == pytest.approx(0.225) and c["a"]["mce"] == pytest.approx(0.7)
    assert c["b"]["ece"] == pytest.approx(0.25625) and c["b"]["mce"] == pytest.approx(0.65)
    assert c["a"]["brier_skill"] == pytest.approx(0.36) and c["b"]["brier_skill"] == pytest.approx(0.2653333333)
    bins = calibrate.reliability_bins(fixture_scores, ["model"]).where("model = 'a'").collect()
    assert {r["bin"]: r["n"] for r in bins} == {1: 1, 2: 2, 4: 2, 6: 1, 8: 1, 9: 1}


def test_calibration_rejects_bad_input(spark):
    bad = spark.createDataFrame([(1, 2, 0.5), (2, 0, float("nan"))], "row_id long, y int, p double")
    with pytest.raises(ValueError):
        calibrate.require_valid(bad, [])
    with pytest.raises(ValueError):
        calibrate.require_valid(bad.limit(0), [])


def test_recalibration_solves_the_score_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    p = 1 / (1 + np.exp(-x))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.4 + 0.7 * x)))).astype(int)
    df = spark.createDataFrame(list(zip(range(2000), y.tolist(), p.tolist())), "row_id long, y int, p double")
    r = calibrate.logistic_recalibration(df, []).first()
    mu = 1 / (1 + np.exp(-(r["calibration_intercept"] + r["calibration_slope"] * x)))
    nu = 1 / (1 + np.exp(-(r["calibration_in_the_large"] + x)))
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * x).sum()) < 1e-6 and abs((y - nu).sum()) < 1e-6


def _bounded_optimum(x, y):
    """Intercept and slope within +-30 by a fine search, for small separable cases."""
    best = None
    for b in np.linspace(-30, 30, 241):
        for a in np.linspace(-30, 30, 601):
            eta = a + b * x
            loss = (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - y * eta).sum()
            if best is None or loss < best[0]:
                best = (loss, a, b)
    return best


def test_recalibration_at_its_bounds_and_undefined_cases(spark):
    p = [0.2, 0.3, 0.35, 0.4, 0.42, 0.45, 0.47, 0.5, 0.6, 0.7]
    rows = [("sep", i, int(v > 0.44), v) for i, v in enumerate(p)] + [("one", i, 1, v) for i, v in enumerate(p)]
    rows += [("ok", i, i % 2, v) for i, v in enumerate(p)] + [("same", i, int(i < 3), 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, row_id long, y int, p double")
    got = {r["k"]: r for r in calibrate.logistic_recalibration(df, ["k"]).collect()}
    x, y = np.log(np.array(p) / (1 - np.array(p))), np.array([int(v > 0.44) for v in p])
    loss, a, b = _bounded_optimum(x, y)
    sep = got["sep"]
    eta = sep["calibration_intercept"] + sep["calibration_slope"] * x
    assert sep["calibration_status"] == "ok" and sep["calibration_slope"] == 30.0
    assert (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - y * eta).sum() <= loss + 1e-9
    assert got["one"]["calibration_status"] == "one_class" and got["one"]["calibration_slope"] is None
    assert got["ok"]["calibration_status"] == "ok" and got["ok"]["calibration_iterations"] < 30
    assert got["same"]["calibration_intercept"] == pytest.approx(np.log(3 / 7))


def test_scores_that_are_no_numbers_are_errors(spark):
    for bad in (float("nan"), None):
        df = spark.createDataFrame([(1, 1, 0.5), (2, 0, bad)], "row_id long, y int, p double")
        with pytest.raises(Exception, match="missing or not a number"):
            metrics.metric_rows(df, []).collect()
        with pytest.raises(Exception, match="missing or not a number"):
            metrics.confusion(df, []).collect()


def _pav(p, y):
    order = np.argsort(p, kind="stable")
    out = []
    for v in sorted(set(p)):
        hit = [y[i] for i in order if p[i] == v]
        out.append([v, v, len(hit), sum(hit)])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [(a, b, s / n) for a, b, n, s in out]


@pytest.mark.parametrize("pooled", [50_000, 6])
def test_isotonic_maps_of_many_keys(many_partitions, pooled):
    rng = np.random.default_rng(pooled)
    rows = []
    for k, n in (("a", 200), ("b", 30), ("c", 1)):
        p = np.round(rng.random(n), 2)
        rows += [(k, i, int(rng.random() < q), float(q)) for i, q in enumerate(p)]
    df = many_partitions.createDataFrame(rows, "k string, row_id long, y int, p double")
    got = {}
    for r in calibrate.isotonic_blocks(df, ["k"], pooled).collect():
        got.setdefault(r["k"], []).append((r["_lo"], r["_hi"], r["_v"]))
    new = many_partitions.createDataFrame([(k, i, 0, i / 97) for k in "abc" for i in range(98)], "k string, row_id long, y int, p double")
    mapped = {(r["k"], r["row_id"]): r["p"] for r in calibrate.isotonic_map(df, new, ["k"]).collect()}
    for k in "abc":
        want = _pav([r[3] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k])
        assert sorted(got[k]) == [pytest.approx(w) for w in want]
        xs, vs = [e for a, b, _ in want for e in (a, b)], [v for _, _, v in want for _ in range(2)]
        for i in range(98):
            assert mapped[k, i] == pytest.approx(float(np.interp(i / 97, xs, vs)))


def test_isotonic_map_is_monotone_and_clipped(spark):
    fit = spark.createDataFrame([(0, 0.2), (0, 0.3), (1, 0.5), (0, 0.6), (1, 0.9)], "y int, p double")
    new = spark.createDataFrame([(1, 0.0), (2, 0.55), (3, 1.0)], "row_id long, p double")
    got = [r["p"] for r in calibrate.isotonic_map(fit, new).orderBy("row_id").collect()]
    assert got == [0.0, pytest.approx(0.5), 1.0]


def test_delong_and_mcnemar_fixture(spark, fixture_scores):
    s = fixture_scores.withColumn("run_id", F.lit("r"))
    d = compare.delong(s, ["run_id"]).first()
    assert d["z"] == pytest.approx(0.3779644730) and d["p_value"] == pytest.approx(0.7054569861)
    m = compare.mcnemar(s, ["run_id"]).first()
    assert (m["b"], m["c"]) == (1, 1) and m["chi2"] == 0.5
    assert m["p_value"] == pytest.approx(math.erfc(math.sqrt(0.25)))
    flipped = s.withColumn("model", F.when(F.col("model") == "a", "b").otherwise("a"))
    assert compare.delong(flipped, ["run_id"]).first()["z"] == pytest.approx(-0.3779644730)


def test_identical_models_have_p_one(spark, fixture_scores):
    s = fixture_scores.where("model = 'a'")
    same = s.unionByName(s.withColumn("model", F.lit("z"))).withColumn("run_id", F.lit("r"))
    d, m = compare.delong(same, ["run_id"]).first(), compare.mcnemar(same, ["run_id"]).first()
    assert (d["z"], d["p_value"], m["chi2"], m["p_value"]) == (0.0, 1.0, 0.0, 1.0)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.04), (0, 0.01), (0, 0.2)], "g int, p double")
    assert [r["h"] for r in compare.holm(df, ["g"], "p", "h").orderBy("p").collect()] == pytest.approx([0.03, 0.08, 0.2])


def test_friedman_fixture(spark):
    data = {"m1": [0.8, 0.82, 0.81, 0.79], "m2": [0.7, 0.71, 0.69, 0.72], "m3": [0.75, 0.76, 0.74, 0.77]}
    rows = [(i, m, v) for m, values in data.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run int, model string, value double").withColumn("g", F.lit(0))
    out = compare.friedman(df, ["g"], "run").orderBy("average_rank").collect()
    assert [r["model"] for r in out] == ["m1", "m3", "m2"]
    assert out[0]["friedman_chi2"] == pytest.approx(8) and out[0]["friedman_p"] == pytest.approx(0.0183156389)
    assert out[0]["nemenyi_cd"] == pytest.approx(1.6567511883)
    one = compare.friedman(df.where("run = 0"), ["g"], "run").first()
    assert one["status"] == "insufficient_runs_or_models" and one["nemenyi_cd"] is None


def test_seeds_of_a_cutoff_are_one_block(spark):
    rows = [("2010-01", "a", "AUROC", 0.7), ("2010-01", "a", "AUROC", 0.8), ("2010-01", "b", "AUROC", 0.6), ("2010-01", "b", "AUROC", 0.9)]
    df = spark.createDataFrame(rows, "cutoff string, model string, metric string, value double")
    assert {r["n_blocks"] for r in compare.descriptive_ranks(df, "cutoff").collect()} == {1}


def test_group_gaps_fixture(spark, fixture_scores):
    a = fixture_scores.where("model = 'a'")
    g = fairness.rate_gaps(fairness.group_rates(a, ["model"], ["g"]), ["model"]).first()
    assert (g["selection_gap"], g["tpr_gap"]) == (0.25, 0.5)
    assert g["fpr_gap"] == pytest.approx(1 / 3) and g["max_gap"] == 0.5

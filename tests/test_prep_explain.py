import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelab.operators import explain, features, prep, robust, summary


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    a[::10] = np.nan
    return pd.DataFrame({"row_id": np.arange(200), "a": a, "b": rng.integers(0, 5, 200).astype(float), "e": np.nan, "fold": np.arange(200) % 3})


def test_statistics_per_fold_match_pandas(many_partitions, toy):
    df = many_partitions.createDataFrame(toy.where(toy.notna(), None).astype({"row_id": int, "fold": int}), "row_id long, a double, b double, e double, fold int")
    out = prep.fit_statistics(df, ["a", "b", "e"], {f"f{k}": F.col("fold") != k for k in range(3)}).toPandas()
    assert len(out) == 9
    for k in range(3):
        part = toy[toy["fold"] != k]
        for c in ("a", "b", "e"):
            r = out[(out["fit"] == f"f{k}") & (out["feature"] == c)].iloc[0]
            median = part[c].median() if part[c].notna().any() else 0.0
            filled = part[c].fillna(median)
            lo, hi = filled.quantile([0.01, 0.99])
            clipped = filled.clip(lo, hi)
            std = clipped.std(ddof=0)
            assert r["median"] == pytest.approx(median) and r["lower"] == pytest.approx(lo) and r["upper"] == pytest.approx(hi)
            assert r["mean"] == pytest.approx(clipped.mean()) and r["scale"] == pytest.approx(std if std > 0 else 1.0)
            assert r["n_missing"] == part[c].isna().sum()


def test_applied_layout_and_values(spark, toy):
    df = spark.createDataFrame(toy.where(toy.notna(), None), "row_id long, a double, b double, e double, fold int")
    stats = prep.fit_statistics(df, ["a", "b"], {"all": F.lit(True)})
    out = prep.apply_statistics(df.withColumn("fit", F.lit("all")), stats, ["a", "b"], ["a"], ["fold"], keep=["row_id"])
    assert out.columns == ["row_id", "a", "b", "a_missing", "fold"]
    got = out.orderBy("row_id").toPandas()
    assert got["a"].notna().all() and got["a_missing"].sum() == 20 and abs(got["a"].mean()) < 0.2


def test_slope_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 4.0, 5.0, 8.0)], [f"t{i}" for i in range(6)])
    got = df.select(features.slope([F.col(f"t{i}") for i in range(6)])).first()[0]
    assert got == pytest.approx(1.2571428571)


def test_income_band(spark):
    df = spark.createDataFrame([("$0",), ("$100,000+",), ("Not displayed",), (None,)], "t string")
    assert [r[0] for r in df.select(features.ordinal_band(F.col("t"))).collect()] == [0.0, 5.0, None, None]


def test_protected_columns_never_move_and_levels_nest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, PAY_1 double, x double, SEX double")
    profile = robust.train_profile(df, ["PAY_1", "x"])
    out = robust.perturb(robust.with_scenarios(df), profile, ["PAY_1", "x", "SEX"], 3).toPandas()
    assert len(out) == 200 * 13
    base = out[out["perturbation"] == "none"].set_index("row_id").sort_index()
    changed = {}
    for (kind, level), g in out.groupby(["perturbation", "level"]):
        g = g.set_index("row_id").sort_index()
        assert (g["SEX"] == base["SEX"]).all()
        changed[(kind, level)] = set(g.index[g["PAY_1"] != base["PAY_1"]])
    assert changed[("missingness", 0.05)] <= changed[("missingness", 0.2)] and changed[("none", 0.0)] == set()
    shift = out[(out["perturbation"] == "covariate_shift") & (out["level"] == 0.1)].set_index("row_id").sort_index()
    std = base["PAY_1"].std(ddof=0)
    assert np.allclose(shift["PAY_1"], base["PAY_1"] + 0.1 * std) and (shift["x"] == base["x"]).all()


def long(spark, rows):
    return spark.createDataFrame(rows, "row_id long, feature string, value double")


def test_gini_and_support(spark):
    df = long(spark, [(1, "a", 1.0), (1, "b", -2.0), (1, "c", 0.0), (2, "a", 0.0), (2, "b", 0.0)])
    r = explain.concentration(df, ["row_id"]).orderBy("row_id").collect()
    assert r[0]["gini"] == pytest.approx(0.4444444444) and r[0]["features_for_mass"] == 2
    assert (r[1]["gini"], r[1]["features_for_mass"]) == (0.0, 2)


def test_reversed_ranks_agree_at_minus_one(spark):
    a = long(spark, [(1, f, v) for f, v in (("x", 1.0), ("y", 2.0), ("z", 3.0))])
    b = long(spark, [(1, f, v) for f, v in (("x", 3.0), ("y", 2.0), ("z", 1.0))])
    assert explain.agreement(a, b).first()["rho"] == -1.0
    assert explain.agreement(a.where("feature <> 'x'"), b).count() == 0


def test_shapley_is_additive_and_exact_for_linear_scores(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, -1.0, 0.5)], "row_id long, a double, b double")
    score = lambda d: d.withColumn("p", 0.1 * F.col("a") - 0.2 * F.col("b"))
    out = explain.shapley_samples(df, {"a": 1.0, "b": 1.0}, score, permutations=3)
    got = {(r["row_id"], r["feature"]): r["value"] for r in out.collect()}
    assert got[(1, "a")] == pytest.approx(0.1) and got[(1, "b")] == pytest.approx(-0.4)
    assert got[(2, "a")] == pytest.approx(-0.2) and got[(2, "b")] == pytest.approx(0.1)


def test_local_surrogate_finds_the_driver(spark):
    df = spark.createDataFrame([(1, 3.0, 0.1), (2, -3.0, 0.1)], "row_id long, a double, b double")
    score = lambda d: d.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("a"))))
    out = explain.local_surrogate(df, {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0}, score, samples=300)
    rows = {(r["row_id"], r["feature"]): r for r in out.collect()}
    assert rows[(1, "a")]["value"] > 0.2 and rows[(2, "a")]["value"] < -0.2
    assert abs(rows[(1, "b")]["value"]) < 0.05 and rows[(1, "a")]["r2"] > 0.5


def test_repair_needs_the_signed_column(spark):
    df = spark.createDataFrame([(0, 0.5, -0.5)], "i int, abs_rank_rho double, signed_rank_rho double")
    assert summary.repair_agreement(df).first()["abs_rank_rho"] == -0.5
    assert summary.repaired_count(df).first()["rows_changed"] == 1
    with pytest.raises(ValueError):
        summary.repair_agreement(df.drop("signed_rank_rho"))


def test_winner_ties_follow_preference(spark):
    df = spark.createDataFrame([("r", "b", 0.8), ("r", "a", 0.8), ("r", "c", 0.7)], "run string, model string, AUROC double")
    assert summary.best_by_metric(df, ["run"], "model", "AUROC", ["c", "b", "a"]).first()["model"] == "b"


def test_missing_inputs_make_missing_features(spark):
    names = [f"{k}{i}" for k in "bpd" for i in range(3)]
    full = {"lim": 10.0, "b0": 10.0, "b1": 20.0, "b2": 0.5, "p0": 5.0, "p1": 5.0, "p2": 5.0, "d0": 2.0, "d1": 0.0, "d2": 0.0}
    rows = [full] + [full | {gone: None} for gone in ("lim", "b1", "p1", "d0", "d1")]
    df = spark.createDataFrame([(i, *[r[c] for c in ("lim", *names)]) for i, r in enumerate(rows)], "i int, lim double, " + ", ".join(f"{n} double" for n in names))
    got = features.period_features(df, "lim", names[:3], names[3:6], names[6:]).orderBy("i").collect()
    made = ["util_rate_mean", "pay_ratio_mean", "avg_pay_delay", "max_pay_delay", "limit_ratio", "delay_spike"]
    missing = [{c for c in made if r[c] is None} for r in got]
    assert missing[:2] == [set(), {"util_rate_mean", "limit_ratio"}]
    assert {"util_rate_mean", "limit_ratio"} <= missing[2]
    assert missing[4] == missing[5] == {"avg_pay_delay", "max_pay_delay"}
    assert [r["delay_spike"] for r in got] == [1, 1, 1, 1, 0, 0] and got[0]["max_pay_delay"] == 2.0


def test_a_single_repeat_is_stable(spark):
    rows = [("a", 1, "x", 0.5), ("a", 1, "y", 0.1), ("b", 1, "x", 0.5), ("b", 1, "y", 0.1), ("b", 2, "x", 0.1), ("b", 2, "y", 0.5)]
    df = spark.createDataFrame(rows, "row_id string, repeat int, feature string, value double")
    got = {r["row_id"]: (r["stability_rho"], r["top_jaccard"]) for r in explain.repeat_stability(df, ["row_id"], 1).collect()}
    assert got["a"] == (1.0, 1.0) and got["b"][0] == pytest.approx(-1.0)

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import resample
from scorelab.operators.neighbours import knn_join


def frame(spark, x, extra=()):
    names = ["id", "vec", *[n for n, _ in extra]]
    rows = [(i, [float(v) for v in row], *[int(values[i]) for _, values in extra]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + "".join(f", {n} int" for n in names[2:]))


def brute(x, q, k, exclude_self):
    out = {}
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not (exclude_self and j == i)]
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_is_exact_with_copies_and_small_blocks(many_partitions, exclude_self):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    x[rng.choice(240, 80, replace=False)] = x[0]
    df = frame(many_partitions, x)
    got = knn_join(df, df, 4, exclude_self, pivots=7, block_rows=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == brute(x, x, 4, exclude_self)


def test_knn_with_fewer_candidates_than_k(spark):
    df = frame(spark, np.array([[0.0], [1.0], [3.0]]))
    assert knn_join(df, df, 5, True).groupBy("query_id").count().where("count <> 2").count() == 0


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    n = 300
    y = (rng.random(n) < 0.15).astype(int)
    a, b = rng.normal(y, 1.0), rng.normal(size=n)
    cat = rng.integers(0, 4, n)
    rows = [(i, int(y[i]), float(a[i]), float(b[i]), int(cat[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, cat int")


@pytest.mark.parametrize("strategy", ["SMOTE", "BorderlineSMOTE", "SVMSMOTE", "ADASYN"])
def test_rebalancing_keeps_originals_and_real_codes(spark, toy, strategy):
    out = resample.resample(toy, strategy, ["a", "b"], ["cat"]).toPandas()
    real = out[~out["is_synthetic"]].copy()
    real["id"] = real["id"].astype(int)
    want = toy.toPandas().sort_values("id")
    got = real.sort_values("id")
    assert np.allclose(got[["a", "b"]], want[["a", "b"]]) and (got["cat"].to_numpy() == want["cat"].to_numpy()).all()
    made = out[out["is_synthetic"]]
    minority = want[want["y"] == 1]
    need = len(want) - 2 * len(minority)
    assert (made["y"] == 1).all() and set(made["cat"]) <= set(minority["cat"])
    assert abs(len(made) - need) <= (len(minority) if strategy == "ADASYN" else 0)
    if strategy != "SVMSMOTE":
        for c in ("a", "b"):
            assert made[c].between(minority[c].min() - 1e-12, minority[c].max() + 1e-12).all()


def test_pass_through(spark, toy):
    for strategy in ("None", "ClassWeight"):
        out = resample.resample(toy, strategy, ["a", "b"], ["cat"])
        assert out.where("is_synthetic").count() == 0 and out.count() == 300


def test_unknown_strategy(toy):
    with pytest.raises(ValueError):
        resample.resample(toy, "Magic", ["a"], [])


def test_smote_does_not_depend_on_partitions(spark, toy):
    a = resample.resample(toy, "SMOTE", ["a", "b"]).where("is_synthetic").orderBy("id").toPandas()
    b = resample.resample(toy.repartition(7), "SMOTE", ["a", "b"]).where("is_synthetic").orderBy("id").toPandas()
    assert a.equals(b)


def test_vote_ties(spark):
    originals = spark.createDataFrame([(1, [0.0], 7), (2, [1.0], 3), (3, [2.0], 3), (4, [3.0], 7), (5, [4.0], 9)], "id long, vec array<double>, c int")
    syn = spark.createDataFrame([(10, [-1.0]), (11, [1.4])], "id long, vec array<double>")
    got = {r["id"]: r["c"] for r in resample.nominal_vote(syn, originals, ["c"], 5).collect()}
    assert got == {10: 7, 11: 3}
    third = {r["id"]: r["c"] for r in resample.nominal_vote(syn, originals.where("id IN (5, 1, 2)"), ["c"], 3).collect()}
    assert third == {10: 7, 11: 3}


def test_large_quota_is_spread(spark):
    df = spark.createDataFrame([(1, 25), (2, 0), (3, 3)], "id long, quota long")
    out = resample.expanded(df, "quota", "i", block=10)
    assert out.groupBy("id").agg(F.count("i").alias("n"), F.max("i").alias("m")).orderBy("id").collect()[0][:] == (1, 25, 24)
    assert out.count() == 28 and out.select("id", "i").distinct().count() == 28


def _plain_svm(x, y, gamma, c, sweeps=3000):
    """Kernel support vector machine: steps on pairs of dual variables, the intercept from free ones."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.where(y == 1, 1.0, -1.0)
    a = np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(sweeps * 10):  # pairs keep the sum of s * a at zero
        i, j = rng.choice(len(y), 2, replace=False)
        f = k @ (a * s)
        eta = k[i, i] + k[j, j] - 2 * k[i, j]
        if eta <= 1e-12:
            continue
        step = ((s[i] - f[i]) - (s[j] - f[j])) / eta
        low, high = -np.inf, np.inf
        for at, sign in ((i, 1.0), (j, -1.0)):
            bounds = sorted(((0 - a[at]) * s[at] * sign, (c - a[at]) * s[at] * sign))
            low, high = max(low, bounds[0]), min(high, bounds[1])
        step = min(max(step, low), high)
        a[i] += s[i] * step
        a[j] -= s[j] * step
    f = k @ (a * s)
    free = (a > 1e-6) & (a < c - 1e-6)
    best = np.median((s - f)[free]) if free.any() else 0.0
    return f + best


def test_margins_of_a_radial_kernel(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 2)).round(3)
    y = ((x**2).sum(axis=1) + 0.3 * rng.normal(size=90) > 1.6).astype(int)
    rows = spark.createDataFrame([(f"r{i}", int(y[i]), x[i].tolist()) for i in range(90)], "id string, y int, vec array<double>")
    got = {r["id"]: r["margin"] for r in resample.radial_margins(rows, rows, landmarks=90).collect()}
    want = _plain_svm(x, y, 1.0 / (2 * x.var()), 1.0, 1500)
    mine = np.array([got[f"r{i}"] for i in range(90)])
    # Spark's solver ends before the hinge's corner is exact: most margins are within hundredths, a far one may be off by more
    assert np.abs(mine - want).mean() < 0.05 and np.quantile(np.abs(mine - want), 0.9) < 0.1 and np.corrcoef(mine, want)[0, 1] > 0.998
    clear = np.abs(np.abs(want) - 1) > 0.1
    assert ((np.where(y == 1, mine, -mine) <= 1) == (np.where(y == 1, want, -want) <= 1))[clear].all() and ((mine > 0) == y).mean() > 0.85
    few = np.array([r["margin"] for r in resample.radial_margins(rows, rows, landmarks=30).orderBy("id").collect()])
    assert np.corrcoef(few, [got[i] for i in sorted(got)])[0, 1] > 0.95

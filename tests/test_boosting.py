"""Boosting against a plain version that looks at every row, node and cut on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.functions.hashing import counter_block
from scorelab.operators import boosting
from scorelab.operators.boosting import Fit, Settings

FEATURES = ["a", "b", "c", "d"]


def make(seed, n=400):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 3, n), rng.random(n).round(3), np.ones(n)])
    logit = 1.5 * x[:, 0] - (x[:, 1] == 2) + np.sin(5 * x[:, 2])
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    w = np.where(y == 1, 1.5, 1.0)
    stop = rng.random(n) < 0.2
    return x, y, w, stop


def frame(spark, data):
    x, y, w, stop = data
    rows = [(f"r{i}", int(y[i]), *map(float, x[i]), float(w[i]), bool(stop[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id string, y int, a double, b double, c double, d double, _w double, _stop boolean").repartition(3)


def plain_q(g, h, s):
    t = np.sign(g) * max(abs(g) - s.alpha, 0)
    return t * t / (h + s.l2) if h + s.l2 > 0 else 0.0


def plain_tree(x, g, h, use, edges, columns, s):
    """Scores of all rows; every cut of every node is tried by masks. ``g`` and ``h`` are zero on rows not used."""

    def best(regions):
        """The best shared cut of some regions: (gain, (feature, edge) or None)."""
        top, cut = 0.0, None
        for f in columns:
            tried = []
            for e in edges[f]:
                gain = 0.0
                for rows in regions:
                    low, high = rows & (x[:, f] <= e), rows & ~(x[:, f] <= e)
                    gain += 0.5 * (plain_q(g[low].sum(), h[low].sum(), s) + plain_q(g[high].sum(), h[high].sum(), s) - plain_q(g[rows].sum(), h[rows].sum(), s))
                    if s.growth != "symmetric":
                        gain -= s.gamma
                        if min(h[low].sum(), h[high].sum()) < s.min_hessian or min((low & use).sum(), (high & use).sum()) < s.min_rows:
                            gain = -np.inf
                tried.append((gain, e))
            most = max((v for v, _ in tried), default=0.0)
            if most > top * (1 + 1e-9) and most > 1e-12:
                top, cut = most, (f, next(e for v, e in tried if v >= most - 1e-9 * abs(most)))
        return top, cut

    def halves(rows, cut):
        low = x[:, cut[0]] <= cut[1]
        return rows & low, rows & ~low

    everyone = np.ones(len(x), bool)
    if s.growth == "symmetric":
        leaves = [everyone]
        for _ in range(s.depth):
            _, cut = best(leaves)
            if cut is None:
                break
            leaves = [m for rows in leaves for m in halves(rows, cut)]
    else:
        leaves, open_ = [], [(everyone, 0, *best([everyone]))]
        while open_:
            open_.sort(key=lambda q: -q[2])
            rows, depth, _, cut = open_.pop(0)
            full = s.growth == "leaf" and s.leaves and len(leaves) + len(open_) + 1 >= s.leaves
            if cut is None or full or 0 <= s.depth <= depth or (rows & use).sum() < 2 * s.min_rows:
                leaves.append(rows)
            else:
                open_ += [(m, depth + 1, *best([m])) for m in halves(rows, cut)]
    out = np.zeros(len(x))
    for rows in leaves:
        total = g[rows].sum()
        out[rows] = -s.rate * np.sign(total) * max(abs(total) - s.alpha, 0) / (h[rows].sum() + s.l2)
    return out


def plain_auroc(p, y):
    p = np.minimum((p * 65536).astype(int), 65535)
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


LEVEL = Settings("level", rounds=12, depth=3, rate=0.3, gamma=0.05, alpha=0.1, l2=1.0, min_hessian=1.0, patience=3)
LEAF = Settings("leaf", rounds=12, depth=4, rate=0.3, leaves=6, alpha=0.2, l2=0.5, min_hessian=0.001, min_rows=8, patience=4)
PLAIN = Settings("symmetric", rounds=12, depth=3, rate=0.3, l2=3.0, patience=50, from_mean=False)


@pytest.fixture(scope="module")
def fitted(spark):
    data = {"one": make(1), "two": make(2, 250)}
    fits = [Fit(f"{s}-{g.growth}", s, g, 7) for s in data for g in (LEVEL, LEAF, PLAIN)]
    fits.append(Fit("drawn", "one", Settings("level", rounds=4, depth=3, rate=0.5, rows=0.6, columns=0.5, patience=9), 5))
    fits.append(Fit("deep", "two", Settings("leaf", rounds=2, depth=-1, leaves=9, min_rows=3, min_hessian=0.0, patience=9), 5))
    sets = [boosting.row_set(frame(spark, d), name, 7) for name, d in data.items()]
    return data, fits, boosting.fit_many(sets, FEATURES, fits, bins=16)


def stream(n, seed=7):
    import hashlib

    digests = [hashlib.md5(f"{seed}|r{i}".encode()).hexdigest() for i in range(n)]
    return [np.array([int(d[a : a + 8], 16) for d in digests]) for a in (0, 8)]


def test_models_equal_the_plain_version(fitted):
    data, fits, models = fitted
    stopped = 0
    for fit in fits:
        x, y, w, stop = data[fit.rows]
        model, s = models[fit.name], fit.settings
        for f, e in enumerate(model.edges):
            want = np.unique(np.quantile(x[~stop, f], np.arange(1, 16) / 16).round(9))
            assert np.allclose(np.unique(e.round(9)), want)
        share = (w * y)[~stop].sum() / w[~stop].sum()
        margin = np.full(len(y), np.log(share / (1 - share)) if s.from_mean else 0.0)
        history, trees = [], 0
        keys = stream(len(y))
        for t in range(s.rounds):
            p = 1 / (1 + np.exp(-margin))
            use = ~stop
            if s.rows < 1:
                at = 1_000_003 * fit.seed + t
                use = use & (counter_block(*keys, at, at)[:, 0] < s.rows * 2**32)
            g, h = np.where(use, w * (p - y), 0.0), np.where(use, w * p * (1 - p), 0.0)
            columns = boosting._columns(fit, t, 4)
            margin = margin + plain_tree(x, g, h, use, model.edges, columns, s)
            trees += 1
            history.append(plain_auroc(1 / (1 + np.exp(-margin[stop])), y[stop]))
            if len(history) - 1 - int(np.argmax(history)) >= s.patience:
                stopped += 1
                break
        assert model.rounds == trees and np.allclose(model.history, history, atol=2e-4)
        assert len(model.trees) == int(np.argmax(model.history)) + 1
        if len(model.trees) == trees:
            assert np.allclose(model.scores(x), margin, atol=1e-8)
        assert sum(v for _, v in model.importances()) == pytest.approx(1.0)
    assert stopped > 0


def test_many_blocks_give_the_same_models(spark):
    """Sums over jobs and blocks, with siblings by difference, against one block in one task."""
    data = make(3, 200)
    fits = [Fit("level", "s", Settings("level", rounds=4, depth=3, rate=0.3, rows=0.7, patience=9), 3),
            Fit("leaf", "s", Settings("leaf", rounds=3, depth=-1, leaves=7, rate=0.3, min_rows=4, patience=1), 3),
            Fit("plain", "s", Settings("symmetric", rounds=3, depth=2, rate=0.3, patience=9, from_mean=False), 3)]
    rows = [boosting.row_set(frame(spark, data), "s", 3)]
    one = boosting.fit_many(rows, FEATURES, fits, bins=8)
    many = boosting.fit_many(rows, FEATURES, fits, bins=8, block_rows=70)
    for name, model in one.items():
        assert np.allclose(model.scores(data[0]), many[name].scores(data[0]))
        assert np.allclose(model.history, many[name].history) and model.rounds == many[name].rounds


def test_column_form_equals_the_model(spark, fitted):
    data, _, models = fitted
    df = frame(spark, data["one"])
    got = {r["id"]: r["p"] for r in df.select("id", models["drawn"].score(*map(F.col, FEATURES)).alias("p")).collect()}
    want = 1 / (1 + np.exp(-models["drawn"].scores(data["one"][0])))
    assert np.allclose([got[f"r{i}"] for i in range(len(want))], want)


def test_one_class_and_no_slice(spark):
    x, y, w, stop = make(4, 60)
    rows = frame(spark, (x, np.zeros(60, int), np.ones(60), np.zeros(60, bool)))
    fits = [Fit("m", "s", Settings(rounds=3, depth=2), 1), Fit("n", "s", Settings("symmetric", rounds=3, depth=2, from_mean=False), 1)]
    models = boosting.fit_many([boosting.row_set(rows, "s")], FEATURES, fits, bins=8)
    assert all(m.rounds == 3 and m.history == [] for m in models.values())
    assert np.ptp(models["m"].scores(x)) < 0.2

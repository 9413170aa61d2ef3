"""Forests: trees against a plain reading of their rules, one block against many, and the queries' size."""

import numpy as np
import pytest

from scorelab.operators import boosting, forest


def gini(c):
    return 1.0 - sum((x / sum(c)) ** 2 for x in c)


def plain(bins, y, w, draws, fit, tree, width, path=1, level=0):
    """Predictions of a tree by recursion over its rows, all cuts of the features it may use tried one by one."""
    s = fit.settings
    c = [float(w[y == k].sum()) for k in (0, 1)]
    best = (1e-12, None, None)
    if level < s.depth and min(c) > 0:
        for f in forest._may_use(np.array([path]), tree, fit.seed, bins.shape[1], s.drawn(bins.shape[1]))[0]:
            for cut in range(width - 1):
                low = bins[:, f] <= cut
                a, b = ([float(w[m & (y == k)].sum()) for k in (0, 1)] for m in (low, ~low))
                if min(draws[low].sum(), draws[~low].sum()) < max(1, s.min_rows):
                    continue
                gain = gini(c) - sum(a) / sum(c) * gini(a) - sum(b) / sum(c) * gini(b)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut)
    out = np.full(len(y), c[1] / sum(c))
    if best[1] is not None:
        low = bins[:, best[1]] <= best[2]
        for i, m in enumerate((low, ~low)):
            out[m] = plain(bins[m], y[m], w[m], draws[m], fit, tree, width, 2 * path + i, level + 1)
    return out


@pytest.mark.parametrize("columns,min_rows,weight", [("all", 1, 1.0), ("sqrt", 1, 3.0), ("log2", 4, 1.0)])
def test_a_tree_follows_the_rules(monkeypatch, columns, min_rows, weight):
    rng = np.random.default_rng(7)
    bins = rng.integers(0, 8, (400, 5)).astype(np.uint8)
    y = (rng.random(400) < 0.2 + 0.08 * bins[:, 0]).astype(int)
    draws = rng.poisson(1, 400) + 1
    w = draws * np.where(y == 1, weight, 1.0)
    fit = forest.Fit("a", "s", forest.Settings(1, 6, min_rows, columns))
    for nodes in (4096, 3):  # a level in one piece, and in many
        monkeypatch.setattr(forest, "NODES", nodes)
        made = forest.grown(bins, y, w, draws, fit, 0, 8)
        assert np.allclose(made.scores(bins), plain(bins, y, w, draws, fit, 0, 8))
        assert len(np.unique(made.nodes(bins))) > 10


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(int)
    made = [(str(i), int(y[i]), *map(float, x[i]), float(i % 3), 2.0 if y[i] else 1.0) for i in range(3000)]
    return spark.createDataFrame(made, "id string, y int, a double, b double, c double, d double, _w double")


def test_blocks_do_not_matter(spark, rows):
    fits = [forest.Fit("x", "s", forest.Settings(5, 7)), forest.Fit("deep", "s", forest.Settings(3, 20, 2, "all"), 1)]
    names, sets = ["a", "b", "c", "d"], [boosting.row_set(rows, "s")]
    one = forest.fit_many(sets, names, fits)
    many = forest.fit_many(sets, names, fits, held=300, block_rows=500)
    x = rows.toPandas()[names].to_numpy()
    for f in fits:
        assert [t.feature[0] for t in one[f.name].trees] == [t.feature[0] for t in many[f.name].trees]
        assert np.allclose(one[f.name].scores(x), many[f.name].scores(x))
        assert sorted(len(t.feature) for t in one[f.name].trees) == sorted(len(t.feature) for t in many[f.name].trees)
        assert dict(one[f.name].importances()) == pytest.approx(dict(many[f.name].importances()))
    assert list(one["x"].edges[3]) == [0.0, 1.0, 2.0]


def test_a_forest_of_full_size_ends(spark, rows):
    """300 trees of depth 12 for four tables at once: one pass, not one per table and level."""
    from time import monotonic

    sets = [boosting.row_set(rows, f"s{i}", i) for i in range(4)]
    began = monotonic()
    models = forest.fit_many(sets, ["a", "b", "c", "d"], [forest.Fit(str(i), f"s{i}", forest.Settings(), i) for i in range(4)])
    assert monotonic() - began < 100 and [len(m.trees) for m in models.values()] == [300] * 4
    x, y = (rows.toPandas()[c].to_numpy() for c in (["a", "b", "c", "d"], "y"))
    p = models["0"].scores(x)
    assert p[y == 1].mean() - p[y == 0].mean() > 0.3


def test_scores_agree_with_another_forest(spark, rows):
    """Spark ML's forest of the same size gives nearly the same probabilities."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    names = ["a", "b", "c", "d"]
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    other = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="_w", numTrees=60, maxDepth=6, seed=1).fit(ready)
    q = np.array([r["q"] for r in other.transform(ready).select(vector_to_array("probability")[1].alias("q")).collect()])
    model = forest.fit_many([boosting.row_set(rows, "s")], names, [forest.Fit("f", "s", forest.Settings(60, 6))])["f"]
    p = model.scores(rows.toPandas()[names].to_numpy())
    assert np.corrcoef(p, q)[0, 1] > 0.98 and abs(p.mean() - q.mean()) < 0.01 and np.abs(p - q).mean() < 0.03
    theirs = dict(zip(names, other.featureImportances.toArray()))
    assert all(abs(v - theirs[n]) < 0.05 for n, v in model.importances())

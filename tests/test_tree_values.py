"""Exact attributions of trees against the sum over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import boosting, scoring, tree_values
from scorelab.operators.tree_values import Leaf, Node


def random_tree(rng, depth, features):
    nodes = []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or cover < 2 or rng.random() < 0.15:
            nodes[at] = Node(-1, 0.0, -1, -1, float(rng.normal()), cover)
            return at
        part = float(rng.integers(0, int(cover) + 1))
        left = grow(level + 1, part)
        right = grow(level + 1, cover - part)
        nodes[at] = Node(int(rng.integers(0, features)), float(rng.integers(-2, 3)), left, right, 0.0, cover)
        return at

    grow(0, 64.0)
    return nodes


def value(nodes, row, known, at=0):
    """The tree's value with only some features known: unknown splits go both ways by their shares."""
    n = nodes[at]
    if n.feature < 0:
        return n.value
    if n.feature in known:
        return value(nodes, row, known, n.left if row[n.feature] <= n.cut else n.right)
    if not n.cover:
        return 0.0
    return sum(nodes[c].cover / n.cover * value(nodes, row, known, c) for c in (n.left, n.right))


def plain(nodes, row, features):
    out = []
    for i in range(features):
        others = [j for j in range(features) if j != i]
        total = 0.0
        for size in range(features):
            for s in combinations(others, size):
                w = factorial(size) * factorial(features - size - 1) / factorial(features)
                total += w * (value(nodes, row, {*s, i}) - value(nodes, row, set(s)))
        out.append(total)
    return out


def test_equals_all_subsets_of_six_features():
    rng = np.random.default_rng(2)
    for _ in range(6):
        trees = [random_tree(rng, 5, 6) for _ in range(2)]
        table = [leaf for t in trees for leaf in tree_values.leaves(t)]
        rows = rng.integers(-3, 4, (7, 6)).astype(float)
        got = tree_values.values(rows, table, 6)
        want = np.array([np.sum([plain(t, r, 6) for t in trees], axis=0) for r in rows])
        assert np.allclose(got, want, atol=1e-12)
        whole = [sum(value(t, r, set(range(6))) for t in trees) for r in rows]
        assert np.allclose(got.sum(axis=1) + tree_values.expected(table), whole)


def test_a_lone_leaf_and_no_rows(spark):
    assert tree_values.leaves([Node(-1, 0.0, -1, -1, 2.0, 5.0)]) == [Leaf(2.0, 1.0, (), (), (), ())]
    none = spark.createDataFrame([], "row_id long, a double")
    assert tree_values.tree_values(none, [Leaf(2.0, 1.0, (), (), (), ())], ["a"]).collect() == []


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)).round(2)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] * x[:, 2]))).astype(int)
    return spark.createDataFrame([(i, f"{i}", int(y[i]), *map(float, x[i])) for i in range(300)], "row_id long, id string, y int, a double, b double, c double")


def test_boosting_margins(spark, rows):
    fits = [boosting.Fit(g, "s", boosting.Settings(g, rounds=4, depth=3, rate=0.3, leaves=5, l2=1.0)) for g in ("level", "leaf", "symmetric")]
    models = boosting.fit_many([boosting.row_set(rows, "s")], ["a", "b", "c"], fits)
    for m in models.values():
        table = tree_values.boosted_leaves(m)
        got = {r["row_id"]: r["v"] for r in tree_values.tree_values(rows, table, m.features).groupBy("row_id").agg(F.sum("value").alias("v")).collect()}
        local = rows.orderBy("row_id").toPandas()[["a", "b", "c"]].to_numpy()
        assert np.allclose([got[i] + tree_values.expected(table) + m.start for i in range(300)], m.scores(local))


def test_forest_probabilities(spark, rows):
    roles = scoring.Roles(("a", "b", "c"))
    prepared = scoring.prepare(rows.drop("id"), roles, None)
    recipe = scoring.Recipe("forest", params={"numTrees": 7, "maxDepth": 5})
    model, scored = scoring.final_scores(prepared, recipe, F.lit(True), F.lit(True))
    table = tree_values.forest_leaves(model.model.stages[-1])
    view = prepared.view("all", F.lit(True))
    parts = tree_values.tree_values(view, table, roles.inputs).groupBy("row_id").agg(F.sum("value").alias("v"))
    both = parts.join(scored, "row_id").collect()
    assert len(both) == 300 and max(abs(r["v"] + tree_values.expected(table) - r["p"]) for r in both) < 1e-9
    whole = {r["row_id"]: r["p"] for r in tree_values.ensemble_value(view, table, roles.inputs).collect()}
    assert all(abs(whole[r["row_id"]] - r["p"]) < 1e-9 for r in both)

"""Many fits of sets that a task can hold: forests stay where they grow, boosting takes no job a level."""

import numpy as np
from pyspark.sql import functions as F

from scorelab.operators import boosting, forest, scoring
from scorelab.plans import model_queries


def loans(spark):
    cols = [F.col("id").alias("row_id"), (F.rand(1) < 0.2 + 0.1 * (F.col("id") % 5)).cast("int").alias("y"), F.rand(2).alias("total"),
            F.rand(3).alias("balance"), F.rand(4).alias("months"), (F.col("id") % 3).cast("string").alias("segment"),
            (F.col("id") % 5).cast("string").alias("priority"), (F.col("id") % 2).cast("int").alias("fold")]
    return spark.range(900).select(*cols).localCheckpoint()


def test_forests_of_a_plan_are_scored_where_they_grow(spark, monkeypatch):
    folds = scoring.Folds.partition("fold", 2)
    p = scoring.prepare(loans(spark), model_queries.ROLES, folds)
    recipes = {"a": model_queries.recipe("forest", numTrees=40, maxDepth=5), "b": model_queries.recipe("forest", "ClassWeight", numTrees=7, maxDepth=3)}

    def scores():
        return {(r["recipe"], r["fold"], r["row_id"]): (r["y"], r["p"]) for r in scoring.oof_plan(p, folds, recipes).collect()}

    fit_many = forest.fit_many
    monkeypatch.setattr(forest, "fit_many", lambda *a, **k: (_ for _ in ()).throw(AssertionError("trees reach the driver")))
    here = scores()
    monkeypatch.setattr(forest, "fit_many", fit_many)
    monkeypatch.setattr(forest, "HELD", 100)  # too small for the sets: by models on the driver
    there = scores()
    assert len(here) == 1800 and here.keys() == there.keys()
    assert all(here[k][0] == there[k][0] and abs(here[k][1] - there[k][1]) < 1e-12 for k in here)


def test_a_set_that_a_task_holds_needs_no_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "_grown", lambda *a: (_ for _ in ()).throw(AssertionError("a job a level")))
    rows = loans(spark).select(F.col("row_id").cast("string").alias("id"), "y", "total", "months")
    fit = boosting.Fit("f", "s", boosting.Settings("level", rounds=3, depth=2))
    assert len(boosting.fit_many([boosting.row_set(rows, "s")], ["total", "months"], [fit])["f"].trees) == 3


def test_joint_cells_give_the_sums_of_each_feature():
    rng = np.random.default_rng(2)
    sizes, n = [40, 3, 64, 5, 2], 2000
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    block = boosting._with_cells({"bins": bins, "y": rng.integers(0, 2, n).astype(float), "w": rng.random(n), "stop": rng.random(n) < 0.1}, sizes)
    assert len(block["cells"]) < len(sizes)
    margin, growth = rng.normal(size=n), boosting.Growth(boosting.Settings())
    plan = boosting._plan(growth, [(-1, 0, -1)], boosting.Fit("f", "s", boosting.Settings()), 0)
    sums, p, at = boosting._node_sums(block, margin, plan, sizes)[0], 1 / (1 + np.exp(-margin)), 0
    for f, size in enumerate(sizes):
        for b in range(size):
            own = (bins[:, f] == b) & ~block["stop"]
            w = block["w"][own]
            want = [(w * (p - block["y"])[own]).sum(), (w * (p * (1 - p))[own]).sum(), own.sum()]
            assert np.allclose(sums[at + b], want)
        at += size

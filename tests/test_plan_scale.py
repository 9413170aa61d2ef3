"""Final fits of several tables are one plan, and levels go on from the nodes that are known."""

import threading

import numpy as np
from pyspark.sql import functions as F

from scorelab.operators import boosting, scoring
from scorelab.plans import model_queries
from scorelab.plans.data_queries import CUTOFFS

SF_DIR = "/root/testdata/sf0.001"


def test_cutoffs_are_boosted_in_one_plan(spark, monkeypatch):
    monkeypatch.setitem(scoring.FAMILY_DEFAULTS, "boost_gain", {"rounds": 3, "depth": 2, "patience": 5})
    plans, fit_many = [], boosting.fit_many

    def counted(sets, features, fits, **more):
        plans.append(len(fits))
        return fit_many(sets, features, fits, **more)

    monkeypatch.setattr(boosting, "fit_many", counted)
    together = {r["cutoff"]: r for r in model_queries._family("boost_gain")(spark, SF_DIR).collect()}
    assert plans == [len(CUTOFFS)] and sorted(together) == CUTOFFS
    rows, train, test = model_queries.temporal(spark, SF_DIR, CUTOFFS[-1])
    alone = scoring.prepare(rows, model_queries.ROLES, None, train)
    _, scored = scoring.final_scores(alone, model_queries.recipe("boost_gain", "ClassWeight"), train, test)
    own = model_queries.metrics.metric_rows(scored.withColumn("model", F.lit("boost_gain")), ["model"], 0.5).first()
    assert {k: v for k, v in together[CUTOFFS[-1]].asDict().items() if k != "cutoff"} == own.asDict()


def test_nodes_go_on_from_an_earlier_stage():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 9, (500, 2)).astype(np.uint8)
    none = np.zeros(5)
    grown = boosting.Tree(np.array([0, 1, -1, -1, -1]), np.array([4, 3, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), none, none, none)
    early = boosting.Tree(np.array([0, -1, -1]), grown.cut[:3], np.array([1, -1, -1]), np.array([2, -1, -1]), none[:3], none[:3], none[:3])
    known = early.nodes(bins)
    kept = known.copy()
    assert np.array_equal(grown.nodes(bins, known), grown.nodes(bins)) and np.array_equal(known, kept)


def test_boosting_families_are_ablated_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(3)

    def found(prepared, folds, recipe, train, test):
        if recipe.family.startswith("boost"):
            meet.wait(60)
        return spark.range(len(prepared))

    monkeypatch.setattr(scoring, "prepare", lambda *a: None)
    monkeypatch.setattr(scoring, "feature_ablation", found)
    rows = model_queries.feature_ablation(spark, SF_DIR).groupBy("model").count().collect()
    assert {tuple(r) for r in rows} == {(f, 2) for f in scoring.FAMILY_ORDER}

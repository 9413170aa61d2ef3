"""The model queries cover every cutoff and every family; fits are replaced by quick ones."""

from pyspark.sql import functions as F

from scorelab.operators import scoring
from scorelab.plans import model_queries
from scorelab.plans.data_queries import CUTOFFS

SF_DIR = "/root/testdata/sf0.001"


def test_every_cutoff_is_scored(spark, monkeypatch):
    seen = []

    def scored(prepared, recipe, train, test):
        rows = prepared.rows.where(test)
        seen.append(tuple(rows.agg(F.min("orig"), F.max("orig")).first()))
        return None, rows.select("row_id", "y", (F.col("row_id") % 7 / 7).alias("p"))

    monkeypatch.setattr(scoring, "final_scores", scored)
    found = model_queries._family("logistic")(spark, SF_DIR)
    assert sorted(r["cutoff"] for r in found.collect()) == CUTOFFS
    assert [f"{a:%Y-%m}" >= c and b.year == int(c[:4]) and b.month <= 6 for c, (a, b) in zip(CUTOFFS, seen, strict=True)] == [True] * 4


def test_search_and_ablation_take_every_family(spark, monkeypatch):
    draws = {}

    def search(prepared, folds, bases, params, train=None):
        draws.update({b.family: len(params[b.family]) for b in bases})
        return spark.createDataFrame([(b.family,) for b in bases], "model string")

    monkeypatch.setattr(scoring, "search_plan", search)
    monkeypatch.setattr(scoring, "feature_ablation", lambda prepared, folds, recipe, train, test: spark.range(len(prepared)))
    assert [r["model"] for r in model_queries.random_search(spark, SF_DIR).collect()] == scoring.FAMILY_ORDER
    assert draws == {f: 7 if f == "logistic" else 12 for f in scoring.FAMILY_ORDER}
    found = model_queries.feature_ablation(spark, SF_DIR).groupBy("model").count().collect()
    assert {tuple(r) for r in found} == {(f, 2) for f in scoring.FAMILY_ORDER}

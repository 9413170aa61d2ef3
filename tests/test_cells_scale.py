"""Rows of equal bins are one cell: fits cost what their cells cost, and the loans are read once for all cutoffs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import boosting, forest, ordering
from scorelab.plans import model_queries


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.floor(F.rand(i) * 6).cast("double").alias(n) for i, n in enumerate("abc")]
    y = (F.rand(9) < 0.1 + 0.1 * F.col("a")).cast("int").alias("y")
    return spark.range(20_000).select(F.col("id").cast("string").alias("id"), *x).select("*", y).localCheckpoint()


def test_blocks_hold_cells_not_rows(rows):
    sets, names = [boosting.row_set(rows, "s")], ["a", "b", "c"]
    packed, _, sizes, _ = forest._blocks(sets, names, 32, 4000)
    blocks = [boosting._unpacked(r, 3) for r in packed.collect()]
    assert len(blocks) == 5 and sum(len(b["y"]) for b in blocks) <= 6**3 * 2
    assert sum(int(b["n"].sum()) for b in blocks) == sizes["s"] == 20_000 == sum(len(b["k0"]) for b in blocks)


def test_a_set_of_few_cells_needs_no_job_a_level(rows, monkeypatch):
    """20,000 rows in blocks of 4,000: the forest's and the boosting's tasks hold their cells."""
    sets, names = [boosting.row_set(rows, "s")], ["a", "b", "c"]
    want = forest.fit_many(sets, names, [forest.Fit("f", "s", forest.Settings(3, 5))])["f"]
    monkeypatch.setattr(forest, "_of_many_blocks", lambda *a: (_ for _ in ()).throw(AssertionError("a job a level")))
    monkeypatch.setattr(boosting, "_grown", lambda *a: (_ for _ in ()).throw(AssertionError("a job a level")))
    got = forest.fit_many(sets, names, [forest.Fit("f", "s", forest.Settings(3, 5))], held=4000, block_rows=4000)["f"]
    x = np.array(rows.select(*names).limit(500).collect())
    assert np.array_equal(got.scores(x), want.scores(x))
    fit = boosting.Fit("b", "s", boosting.Settings("level", rounds=3, depth=3, rows=0.7, rate=0.3))
    one = boosting.fit_many(sets, names, [fit])["b"]
    assert np.allclose(one.scores(x), boosting.fit_many(sets, names, [fit], block_rows=4000)["b"].scores(x))


def test_margins_that_newer_ones_replace_are_deleted(rows, monkeypatch):
    """Blocks are not written again with the margins, and at most two tables of margins lie in the checkpoint folder."""
    sets, names = [boosting.row_set(rows, "s")], ["a", "b", "c"]
    fit = boosting.Fit("b", "s", boosting.Settings("leaf", rounds=6, depth=3, leaves=5, rows=0.7, rate=0.3))
    one = boosting.fit_many(sets, names, [fit])["b"]
    monkeypatch.setattr(boosting, "CUT", 1)
    monkeypatch.setattr(boosting, "KEYS", 100)  # its rows are drawn, and their keys too many for a task
    seen, superseded = [], boosting._superseded

    def watched(context, old, new):
        out = superseded(context, old, new)
        folder = new.removeprefix("file:")
        seen.append((old is None or old == new or not os.path.exists(old.removeprefix("file:")), sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))))
        return out

    monkeypatch.setattr(boosting, "_superseded", watched)
    many = boosting.fit_many(sets, names, [fit], block_rows=4000)["b"]
    x = np.array(rows.select(*names).limit(500).collect())
    assert np.allclose(one.scores(x), many.scores(x))
    assert len(seen) >= 5 and all(gone for gone, _ in seen) and max(size for _, size in seen) < 30_000  # 432 margins, not 20,000 rows


def test_a_cell_of_many_rows_is_dealt_in_pieces():
    n = 30_000
    rows = {"bins": np.zeros((n, 2), np.uint8), "y": np.arange(n) % 2 * 1.0, "w": np.ones(n), "stop": np.zeros(n, bool), "n": np.ones(n, np.uint32),
            "k0": np.arange(n, dtype=np.uint32), "k1": np.arange(n, dtype=np.uint32) % 2}
    block, hashes = boosting.collapsed([rows])
    parts = dict(boosting._dealt(block, hashes, 4))
    assert block["n"].tolist() == [15_000, 15_000] and len(parts) > 1 and max(p["n"].max() for p in parts.values()) <= boosting.PIECE
    again, _ = boosting.collapsed(list(parts.values()))
    ends = np.cumsum(again["n"])
    for i, end in enumerate(ends):  # keys stay with their cell
        assert (again["k1"][end - again["n"][i] : end] == again["y"][i]).all()
    assert sorted(again["k0"].tolist()) == list(range(n))


def test_scored_cells_are_remembered(spark, rows):
    model = forest.fit_many([boosting.row_set(rows, "s")], ["a", "b", "c"], [forest.Fit("f", "s", forest.Settings(3, 5))])["f"]
    got = rows.select("a", "b", "c", model.score(*map(F.col, "abc")).alias("p")).toPandas()
    assert np.array_equal(got["p"], model.scores(got[["a", "b", "c"]].to_numpy()))


def test_the_loans_are_read_once_for_all_cutoffs(spark, monkeypatch):
    read = []
    features = model_queries.loan_features
    monkeypatch.setattr(model_queries, "loan_features", lambda *a: read.append(1) or features(*a))
    out = model_queries.per_cutoff(spark, "/root/testdata/sf0.001", lambda p, train, test: p.stats.select("fit", "feature", "n"))
    assert len(read) == 1 and out.select("cutoff").distinct().count() == len(model_queries.CUTOFFS)


@pytest.mark.parametrize("probs", [[i / 32 for i in range(1, 32)], [0.0, 0.01, 0.5, 0.99, 1.0]])
def test_only_rows_near_a_quantile_are_looked_at(spark, probs):
    values = np.random.default_rng(1).normal(size=5000).round(3)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    found = {r["q"]: r["value"] for r in ordering.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert np.allclose([found[q] for q in probs], np.quantile(values, probs))
    ranked = spark.range(100_000).select((F.col("id")).alias("x_before"), F.lit(1).alias("n"), F.lit(100_000).alias("x_total"))
    assert ranked.where(ordering._may_serve("x", "n", probs)).count() < 8 * len(probs)


def test_the_scores_of_a_line_move_together(spark):
    """The join of scores and groups sees one row a line, not one per model."""
    from scorelab.plans import base, fairness_queries

    d = "/root/testdata/sf0.001"
    got = fairness_queries.grouped(spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Join")  # models come after the join
    assert got.groupBy("model").count().count() == 3 and got.select("row_id", "model").distinct().count() == base.scores(spark, d).select("row_id", "model").distinct().count()

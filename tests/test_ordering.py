import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelab.operators.ordering import average_ranks, exact_quantiles, numbered, prefix_sums, weighted_quantiles


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows; values tie across partition borders."""
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcde"), n))
    return pd.DataFrame({"k": key, "v": rng.integers(0, 900, n) / 7.0, "w": rng.integers(0, 5, n), "id": np.arange(n)})


def test_prefix_sums_over_many_chunks(many_partitions, skewed):
    df = many_partitions.createDataFrame(skewed).groupBy("k", "v").agg(F.sum("w").alias("w"))
    got = prefix_sums(df, ["k"], ["v"], {"w": "w"})
    assert got.select("k").where("k = 'hot'").count() > 500
    out = got.toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = skewed.groupby(["k", "v"], as_index=False)["w"].sum().sort_values(["k", "v"]).reset_index(drop=True)
    before = want.groupby("k")["w"].cumsum() - want["w"]
    assert (out["w_before"].to_numpy() == before.to_numpy()).all()
    assert (out["w_total"].to_numpy() == want.groupby("k")["w"].transform("sum").to_numpy()).all()


def test_the_hot_key_really_spans_chunks(many_partitions, skewed):
    from scorelab.operators.ordering import CHUNK, in_chunks

    chunks = in_chunks(many_partitions.createDataFrame(skewed), ["k"], ["id"])
    assert chunks.where("k = 'hot'").select(CHUNK).distinct().count() > 3


def test_numbered_is_a_permutation_per_key(many_partitions, skewed):
    out = numbered(many_partitions.createDataFrame(skewed), ["k"], ["v", "id"]).toPandas()
    for _, g in out.groupby("k"):
        assert sorted(g["rn"]) == list(range(1, len(g) + 1))
        assert (g["rn_total"] == len(g)).all()
        assert (g.sort_values(["v", "id"])["rn"].diff().dropna() == 1).all()


@pytest.mark.parametrize("probs", [[0.0, 0.01, 0.5, 0.99, 1.0], [i / 40 for i in range(41)]])
def test_quantiles_match_numpy(many_partitions, skewed, probs):
    out = exact_quantiles(many_partitions.createDataFrame(skewed), ["k"], "v", probs).toPandas()
    assert len(out) == len(probs) * skewed["k"].nunique()
    for k, g in skewed.groupby("k"):
        got = out[out["k"] == k].sort_values("q")["value"].to_numpy()
        assert np.allclose(got, np.quantile(g["v"], probs), rtol=0, atol=1e-12)


def test_quantiles_of_several_weights_share_a_pass(many_partitions):
    rows = [("f", float(v), a, b) for v, a, b in [(1, 2, 0), (2, 0, 1), (5, 1, 1), (9, 3, 2)]]
    df = many_partitions.createDataFrame(rows, "f string, v double, a long, b long")
    out = weighted_quantiles(df, ["f"], "v", {"x": "a", "y": "b"}, [0.25, 0.5]).toPandas()
    full = {"x": [1, 1, 5, 9, 9, 9], "y": [2, 5, 9, 9]}
    for name, values in full.items():
        got = out[out["weight"] == name].sort_values("q")["value"].to_numpy()
        assert np.allclose(got, np.quantile(values, [0.25, 0.5]))


def test_single_row_quantile(spark):
    df = spark.createDataFrame([("a", 3.5)], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", [0.01, 0.5, 0.99]).agg(F.min("value"), F.max("value")).first()[:] == (3.5, 3.5)


def test_average_ranks_match_pandas(many_partitions, skewed):
    out = average_ranks(many_partitions.createDataFrame(skewed), ["k"], "v").toPandas().set_index("id").sort_index()
    want = skewed.groupby("k")["v"].rank()
    assert np.allclose(out["rank"].to_numpy(), want.to_numpy())

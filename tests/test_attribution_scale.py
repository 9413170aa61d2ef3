import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.functions.hashing import md5_uniforms
from scorelab.operators import explain


def test_blocks_of_md5_are_md5():
    heads = [b"42|1", b"42|22", b"42", b"42|" + "größe".encode(), b"x" * 60]
    tails = [f"|{m}|{f}".encode() for m in (0, 9, 10, 199) for f in ("a", "total")]
    plain = np.array([[int(hashlib.md5(h + t).hexdigest()[:8], 16) / 2.0**32 for t in tails] for h in heads])
    assert (md5_uniforms(heads, tails, block=3) == plain).all()
    some = np.arange(plain.size).reshape(plain.shape) % 3 == 0
    assert (md5_uniforms(heads, tails, some) == np.where(some, plain, 0.0)).all()


def test_samples_are_the_same_by_blocks_and_by_columns(spark):
    rows = [(1, 3.0, 0.1, "u"), (None, -3.0, None, "v"), (77, 0.5, 2.0, None)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, other string")
    args = ({"a": 0.0, "b": 1.0}, {"a": 1.0, "b": 2.0}, 120, 42, "row_id")
    columns = ["row_id", "other", "a", "b", "_b_a", "_b_b"]
    one = explain._md5_samples(df, *args).select(*columns).toPandas()
    two = explain._column_samples(df, *args, "md5").select(*columns).toPandas()
    assert len(one) == 360 and (one[["row_id", "other", "_b_a", "_b_b"]].fillna("-") == two[["row_id", "other", "_b_a", "_b_b"]].fillna("-")).all().all()
    assert np.allclose(one[["a", "b"]], two[["a", "b"]], atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_samples_of_few_rows_are_spread(spark, method):
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "row_id long, a double").coalesce(1)
    seen = []

    def score(sampled):
        seen.append(sampled.select(F.spark_partition_id().alias("p")).distinct().count())
        return sampled.withColumn("p", F.col("a"))

    out = explain.local_surrogate(df, {"a": 0.0}, {"a": 1.0}, score, samples=50, method=method)
    assert out.count() == 40 and seen[0] > 1


def test_hybrids_never_travel(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(20)], "row_id long, a double, b double")
    out = explain.shapley_samples(df, {"a": 1.0, "b": 0.0}, lambda d: d.withColumn("p", F.col("a") * F.col("b")), permutations=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan  # the rows, before they become hybrids


def test_undefined_scores_leave_out_their_permutations_only(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.0, 3.0)], "row_id long, a double, b double")
    out = explain.shapley_samples(df, {"a": 0.0, "b": 0.0}, lambda d: d.withColumn("p", F.col("a") + F.col("b")), permutations=8)
    got = {(r["row_id"], r["feature"]): r["value"] for r in out.collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): None, (2, "a"): 2.0, (2, "b"): 3.0}

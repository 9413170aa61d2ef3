"""Pairs of models: cases stand side by side before their places are looked up, also where a model lacks some of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import compare


def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(240):
        y = int(i % 3 == 0)
        for m, p in zip("abc", np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2, 3), 0, 1), 1).tolist()):
            if m != "b" or i % 5:
                out.append(("r", m, f"c{i}", y, p))
    return out, spark.createDataFrame(out, "run_id string, model string, row_id string, y int, p double")


def plain_z(out, a, b):
    p = {m: {r[2]: (r[3], r[4]) for r in out if r[1] == m} for m in (a, b)}
    both, v = sorted(p[a].keys() & p[b].keys()), {}
    for m in (a, b):
        pos, neg = (np.array([x for y, x in p[m].values() if y == k]) for k in (1, 0))
        v[m] = {k: np.mean((neg < x) + 0.5 * (neg == x)) if y else np.mean((pos > x) + 0.5 * (pos == x)) for k, (y, x) in p[m].items()}
    gap = {k: np.array([v[a][c] - v[b][c] for c in both if p[a][c][0] == k]) for k in (0, 1)}
    return gap[1].mean() / np.sqrt(sum(g.var(ddof=1) / len(g) for g in gap.values()))


@pytest.mark.parametrize("few", [True, False])
def test_cases_side_by_side(spark, monkeypatch, few):
    out, scores = rows(spark)
    if few:  # few distinct scores go to the cases
        monkeypatch.setattr(compare, "join_on_value", lambda *a: (_ for _ in ()).throw(AssertionError("cases were shuffled by score")))
    else:
        monkeypatch.setattr(compare, "BROADCAST_ROWS", 2)
    found = {(r["model_a"], r["model_b"]): r for r in compare.delong(scores, ["run_id"]).collect()}
    assert sorted(found) == [("a", "b"), ("a", "c"), ("b", "c")]
    for pair, r in found.items():
        assert r["z"] == pytest.approx(plain_z(out, *pair))
    n = {(r["model_a"], r["model_b"]): r["b"] + r["c"] for r in compare.mcnemar(scores, ["run_id"]).collect()}
    matrix = {tuple(sorted((r["model_a"], r["model_b"]))): r for r in compare.pairwise_matrix(scores, ["run_id"]).collect()}
    for pair, r in found.items():
        assert matrix[pair]["delong_z"] == pytest.approx(abs(r["z"])) and matrix[pair]["mcnemar_b"] + matrix[pair]["mcnemar_c"] == n[pair]

import numpy as np
import pandas as pd

from scorelab.operators import neighbours


def test_routed_queries_leave_in_small_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, vec array<double>").coalesce(1)
    sizes, made = [], pd.DataFrame
    frames = type(df)
    plain = frames.mapInPandas

    def watched(self, run, schema, *more, **named):
        if "qvec" in [f.name for f in schema.fields]:
            batch = made({"id": np.arange(600), "vec": list(points)})
            sizes.extend(len(out) for out in run(iter([batch])))
        return plain(self, run, schema, *more, **named)

    monkeypatch.setattr(frames, "mapInPandas", watched)
    found = neighbours.knn_join(df, df, 3, exclude_self=True, pivots=16).collect()
    assert sizes and max(sizes) <= neighbours.ROUTED * 16 < sum(sizes)
    square = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    want = np.argsort(square, axis=1, kind="stable")[:, :3]
    got = {(r["query_id"], r["rank"]): r["id"] for r in found}
    assert len(got) == 1800 and all(got[i, j + 1] == want[i, j] for i in range(600) for j in range(3))


def test_products_of_a_block_are_bounded(monkeypatch):
    """A block's memory does not grow with its queries times its candidates."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(900, 4)), rng.normal(size=(700, 4))
    y[100] = y[3]
    seen, plain = [], neighbours.closest

    def watched(a, b, need):
        seen.append(len(a) * len(b))
        return plain(a, b, need)

    want = plain(x, y, 5)
    monkeypatch.setattr(neighbours, "closest", watched)
    monkeypatch.setattr(neighbours, "PRODUCTS", 10_000)
    found = neighbours.closest_of_block(x, y, 5)
    assert max(seen) <= 10_000 and all(np.array_equal(a, b) for a, b in zip(found[:2], want)) and np.allclose(found[2], want[2])

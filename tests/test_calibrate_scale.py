"""Isotonic maps in linear time: no window frame is walked again for every row."""

import numpy as np

from scorelab.operators import calibrate


def test_isotonic_map_walks_no_frame_to_the_end(many_partitions, monkeypatch):
    plans, join = [], calibrate.join_on_value

    def seen(df, table, *rest):
        plans.append(table._jdf.queryExecution().analyzed().toString())
        return join(df, table, *rest)

    monkeypatch.setattr(calibrate, "join_on_value", seen)
    rng = np.random.default_rng(3)
    p = rng.random(300).round(3)
    fit = many_partitions.createDataFrame([(i, int(y), float(x)) for i, (x, y) in enumerate(zip(p, rng.random(300) < p))], "row_id long, y int, p double")
    blocks = sorted(tuple(r) for r in calibrate.isotonic_blocks(fit, []).select("_lo", "_hi", "_v").collect())
    asked = np.linspace(-0.1, 1.1, 501)
    new = many_partitions.createDataFrame([(i, float(x)) for i, x in enumerate(asked)], "row_id long, p double")
    got = [r["p"] for r in calibrate.isotonic_map(fit, new).orderBy("row_id").collect()]
    assert len(plans) == 1 and "unboundedpreceding" in plans[0] and "unboundedfollowing" not in plans[0]
    x, v = zip(*[(at, v) for lo, hi, v in blocks for at in ((lo, hi) if hi > lo else (lo,))])
    assert np.allclose(got, np.interp(asked, x, v), atol=1e-12)

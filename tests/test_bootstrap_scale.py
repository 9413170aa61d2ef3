import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import bootstrap


@pytest.mark.parametrize("reps", [1, 2, 7, 8])
def test_packed_weights_come_back(reps):
    w = np.random.default_rng(1).poisson(1.0, (50, reps)).astype(np.uint8)
    w[3, 0], w[4, -1], w[5] = 200, 16, 15
    if reps > 1:
        rows = bootstrap._packed(w)
        assert (bootstrap._unpacked(rows, reps) == w).all() and len(rows[0]) == (reps + 1) // 2 or w[0].max() > 15


@pytest.mark.parametrize("mode", ["poisson", "multinomial"])
def test_arrays_of_a_chunk_are_in_one_row(many_partitions, monkeypatch, mode):
    seen = []
    made = bootstrap._chunk_sums

    def watched(draw, by):
        run = made(draw, by)

        def counted(frames):
            def each():
                for frame in frames:
                    assert (frame["_pos"].notna() == (frame["_row"] == 0)).all()
                    assert not frame.duplicated([*by, "_row"])[frame["_row"] == 0].any()
                    yield frame

            yield from run(each())

        seen.append(by)
        return counted

    monkeypatch.setattr(bootstrap, "_chunk_sums", watched)
    rng = np.random.default_rng(2)
    rows = [(m, i, int(rng.random() < 0.4), float(rng.random())) for i in range(90) for m in ("a", "b")]
    df = many_partitions.createDataFrame(rows, "model string, row_id long, y int, p double")
    cut = df.select("model").distinct().withColumn("threshold", F.lit(0.5))
    found = bootstrap.replicate_metrics(df, cut, [], 9, 3, mode=mode)
    assert found.count() == 2 * 9 * len(bootstrap.METRICS) and seen


def test_totals_of_draws_need_no_row_per_draw(many_partitions):
    rows = many_partitions.range(300).withColumnRenamed("id", "row_id")
    w = bootstrap.with_multinomial_weights(rows, ["row_id"], 0, 49, 9)
    out = bootstrap.draw_totals(w)
    got = sorted(tuple(r) for r in out.select("rep", "draws", "rows_in_all").collect())
    assert got == [(i, 300, 300) for i in range(50)]

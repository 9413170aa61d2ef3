from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scorelab.operators import labels, prep, scoring, splits

LOANS = [
    (1, "2011-01-15", "Defaulted", "2011-09-01", 7.0, 1),
    (2, "2011-01-15", "Chargedoff", "2013-02-01", 24.0, 0),
    (3, "2013-06-01", "Current", None, None, -1),
    (4, "2011-01-15", "Completed", "2012-01-01", None, 0),
    (5, "2011-01-15", "Current", None, None, 0),
    (6, "2013-09-01", "Completed", "2014-01-01", None, 0),
    (7, "2011-01-15", "Defaulted", None, None, -1),
    (8, "2011-01-15", "Defaulted", "2011-09-01", None, 1),
    (9, "2011-01-15", "Defaulted", "2011-01-14 12:00:00", None, -1),
    (10, "2011-01-15", "Cancelled", None, None, -1),
    (11, "2011-01-15", None, None, None, 0),
]


def test_horizon_label_cases(spark):
    df = spark.createDataFrame(LOANS, "row_id long, orig string, status string, closed string, cycle double, want int")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("orig", "closed")})
    out = labels.horizon_label(df, 12, F.lit("2014-03-12").cast("timestamp"))
    assert [(r["row_id"], r["y"]) for r in out.where("y <> want").collect()] == []


def test_snapshot_is_the_latest_origination_or_close(spark):
    df = spark.createDataFrame([(datetime(2010, 1, 1), datetime(2012, 1, 1)), (datetime(2011, 1, 1), None)], "orig timestamp, closed timestamp")
    assert labels.snapshot_of(df).first()["snapshot"] == datetime(2012, 1, 1)


def test_month_end_is_clipped(spark):
    df = spark.createDataFrame([(datetime(2011, 1, 31),)], "orig timestamp")
    assert df.select(labels.observable_by(F.col("orig"), 1)).first()[0] == datetime(2011, 2, 28)


@pytest.mark.parametrize("values,want", [([1, 2, 1], [0, 1, 0]), ([0, 1, 1], [1, 0, 0]), (["bad", "Good", "1"], [1, 0, 1])])
def test_target_coding(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["i", "t"])
    out = labels.recode_target(df, "t").orderBy("i").select("y").collect()
    assert [r["y"] for r in out] == want


def test_unknown_target_coding_is_an_error(spark):
    with pytest.raises(ValueError):
        labels.recode_target(spark.createDataFrame([(3,), (1,)], ["t"]), "t")


def _months(spark):
    rows, k = [], 0
    for m in range(48):
        start = datetime(2005 + m // 12, m % 12 + 1, 1)
        known = datetime(2006 + m // 12, m % 12 + 1, 1)
        for i in range(20):
            rows.append((k, start, known, 1 if k % 5 == 4 else 0))
            k += 1
    return spark.createDataFrame(rows, "row_id long, orig timestamp, observable_by timestamp, y int")


def test_forward_folds_use_only_known_labels(many_partitions):
    cases = _months(many_partitions)
    folds = splits.forward_folds(cases, 3)
    members = splits.forward_membership(cases, folds)
    splits.require_forward_folds(members, folds, 3)
    joined = members.join(cases.drop("y"), "row_id").join(folds.select("fold", "boundary").distinct(), "fold")
    train = joined.where("part = 'train'")
    assert train.where("orig >= boundary OR observable_by > boundary").count() == 0
    valid = joined.where("part = 'validation'")
    assert valid.where("orig < boundary").count() == 0
    assert valid.groupBy("row_id").count().where("count > 1").count() == 0
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()]
    assert sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1
    assert train.count() > 0


def test_too_few_months_is_an_error(spark):
    cases = _months(spark).where("orig < timestamp'2005-03-01'")
    folds = splits.forward_folds(cases, 3)
    with pytest.raises(ValueError):
        splits.require_forward_folds(splits.forward_membership(cases, folds), folds, 3)


def test_unknown_dates_never_train(spark):
    late = datetime(2001, 2, 1)
    cases = spark.createDataFrame(
        [(1, datetime(2001, 1, 5), None, 0), (2, None, late, 1), (3, datetime(2001, 1, 5), late, 0)],
        "row_id long, orig timestamp, observable_by timestamp, y int",
    )
    known = {r["row_id"]: r["a"] for r in cases.select("row_id", splits.available_from().alias("a")).collect()}
    assert known == {1: None, 2: None, 3: late}
    with pytest.raises(ValueError, match="2 cases"):
        splits.require_dates(cases)
    months = _months(spark)
    hidden = months.where("row_id % 7 = 0").withColumn("observable_by", F.lit(None).cast("timestamp")).withColumn("row_id", F.col("row_id") + 10_000)
    both = months.union(hidden)
    folds = splits.forward_folds(both, 3)
    members = splits.forward_membership(both, folds)
    assert members.where("part = 'train' AND row_id >= 10000").count() == 0
    with pytest.raises(ValueError, match="k >= 2"):
        splits.require_forward_folds(members, folds, 1)


def test_forward_flags_equal_the_membership(spark):
    cases = _months(spark)
    folds = splits.forward_folds(cases, 3)
    want = {(r["row_id"], r["part"], r["fold"]) for r in splits.forward_membership(cases, folds).collect()}
    got = set()
    for r in scoring.with_forward_flags(cases).collect():
        got |= {(r["row_id"], "train", f) for f in r["train_folds"]} | {(r["row_id"], "validation", f) for f in r["valid_folds"]}
    assert got == want
    with pytest.raises(ValueError):
        scoring.with_forward_flags(cases.where("orig < timestamp'2005-03-01'"))


def test_rolling_origin_parts_are_disjoint_and_guarded(spark):
    cases = _months(spark)
    s = splits.rolling_origin(cases, ["2007-01", "2008-06"], 6)
    assert s.groupBy("cutoff", "row_id").count().where("count > 1").count() == 0
    assert s.where("part = 'train' AND observable_by > cutoff_at").count() == 0
    snapshot = cases.agg(F.max("orig").alias("snapshot"))
    guards = {r["cutoff"]: r["status"] for r in splits.split_guards(s, ["1980-01", "2007-01", "2008-06"], snapshot, 12).collect()}
    assert guards == {"1980-01": "empty_part", "2007-01": "ok", "2008-06": "test_labels_not_observable"}
    with pytest.raises(ValueError):
        splits.require_usable(splits.split_guards(s, ["1980-01", "2007-01"], snapshot, 12))


def test_split_and_folds_do_not_depend_on_partitions(spark):
    cases = _months(spark)
    a = {r["row_id"]: r["part"] for r in splits.stratified_split(cases).collect()}
    b = {r["row_id"]: r["part"] for r in splits.stratified_split(cases.repartition(11)).collect()}
    assert a == b and sum(v == "test" for v in a.values()) == round(0.2 * 768) + round(0.2 * 192)
    folds = splits.stratified_folds(cases).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_small_fits_get_no_stopping_slice(spark):
    cases = _months(spark)
    assert splits.early_stopping_slice(cases.where("row_id < 40")).where("is_stop OR has_slice").count() == 0
    assert splits.early_stopping_slice(cases.where("row_id < 40"), min_rows=20, min_per_class=2).where("is_stop").count() > 0
    assert splits.early_stopping_slice(cases).where("is_stop").count() == round(76.8) + round(19.2)


def test_vocabulary_codes(spark):
    train = spark.createDataFrame([("x",), ("y",), ("x",)], ["c"])
    test = spark.createDataFrame([(1, "y"), (2, "z"), (3, None)], "i int, c string")
    words = prep.vocabulary(train, ["c"])
    out = prep.encode(test, words, ["c"]).orderBy("i").collect()
    assert [r["c"] for r in out] == [1, 2, 2]

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import scoring
from scorelab.sources import readers, sinks


def test_whitespace_file(spark, tmp_path):
    names = ["a", "b", "c"]
    (tmp_path / "x.asc").write_text("laufkont laufzeit moral\n1 18 4\n 2  9   4\n")
    out = readers.read_whitespace(spark, str(tmp_path / "x.asc"), names)
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, 18.0, 4.0), (2.0, 9.0, 4.0)]
    (tmp_path / "bad.asc").write_text("h h h\n1 2 3\n1 2\n")
    with pytest.raises(Exception, match="expected 3 columns"):
        readers.read_whitespace(spark, str(tmp_path / "bad.asc"), names).collect()


def test_percent_and_complete_rows(spark):
    df = spark.createDataFrame([("13.5%", 1.0, "x"), (None, 2.0, "y")], "int_rate string, v double, issue_d string")
    assert [tuple(r) for r in readers.clean_club_sample(df).collect()] == [(13.5, 1.0)]


def test_first_row_in_file_order_wins(spark, tmp_path):
    lines = ["LoanKey,v"] + [f"k{i % 50},{i}" for i in range(5000)]
    (tmp_path / "loans.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.with_file_order(readers.read_delimited(spark, str(tmp_path / "loans.csv")))
        assert df.rdd.getNumPartitions() > 4
        out = readers.first_per_key(df, ["LoanKey"], ["_ordinal"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["LoanKey"]: int(r["v"]) for r in out} == {f"k{i}": i for i in range(50)}


def test_saved_runs_are_found_by_folder(spark, tmp_path):
    for run, seed in (("seed_1", 1), ("seed_2", 2)):
        folder = tmp_path / run / "results"
        folder.mkdir(parents=True)
        (folder / "run_manifest.json").write_text(json.dumps({"run_id": "ignored", "seed": seed}))
    out = readers.read_saved_runs(spark, str(tmp_path / "*/results/run_manifest.json"))
    assert {r["run_id"]: r["seed"] for r in out.collect()} == {"seed_1": 1, "seed_2": 2}


def test_incomplete_runs_stay_hidden_and_nothing_is_overwritten(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, v double")
    sinks.retract_runs(spark, root, ["r1", "r2"])
    sinks.write_run_table(df, root, "m")
    sinks.complete_runs(spark, root, {"r1": "s"})
    assert [r["run_id"] for r in sinks.read_complete(spark, root, "m").collect()] == ["r1"]
    sinks.write_run_table(df.where("run_id = 'r2'").withColumn("v", F.lit(9.0)), root, "m")
    assert spark.read.parquet(f"{root}/m").count() == 2
    sinks.write_new(df, f"{root}/new")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_new(df, f"{root}/new")


def test_fingerprint_ignores_row_order_only(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = readers.fingerprint(df).first(), readers.fingerprint(df.orderBy(F.desc("id"))).first()
    c = readers.fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")))).first()
    assert a == b and a["hash_sum"] != c["hash_sum"]


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(4)
    n = 240
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * a))).astype(int)
    rows = [(i, int(y[i]), None if i % 9 == 0 else float(a[i]), float(b[i]), "xyz"[i % 3], i % 3, "test" if i % 4 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, a double, b double, c string, fold int, part string")


ROLES = scoring.Roles(("a", "b"), ("a",), ("c",))


def test_oof_covers_every_training_row_once(spark, cases):
    train = F.col("part") == "train"
    folds = scoring.Folds.partition("fold", 3)
    prepared = scoring.prepare(cases, ROLES, folds, train)
    oof = scoring.oof_scores(prepared, folds, scoring.Recipe("logistic", "ClassWeight", params={"maxIter": 20}), train)
    want = {r["row_id"] for r in cases.where(train).collect()}
    got = [r["row_id"] for r in oof.collect()]
    assert len(got) == len(want) and set(got) == want


def test_test_rows_do_not_touch_the_fit(spark, cases):
    train, test = F.col("part") == "train", F.col("part") == "test"
    spoiled = cases.withColumns({"a": F.when(test, 1e9).otherwise(F.col("a")), "c": F.when(test, F.lit("new")).otherwise(F.col("c"))})
    recipe = scoring.Recipe("logistic", params={"maxIter": 20})
    weights = []
    for df in (cases, spoiled):
        prepared = scoring.prepare(df, ROLES, None, train)
        model, scored = scoring.final_scores(prepared, recipe, train, test)
        weights.append(model.importances())
        assert scored.where("p IS NULL").count() == 0
    assert dict(weights[0]) == pytest.approx(dict(weights[1]))


def test_unseen_nominal_is_all_zero(spark, cases):
    train = F.col("part") == "train"
    prepared = scoring.prepare(cases, ROLES, None, train)
    model = scoring.fit(prepared.view("all", train), ROLES, prepared.levels, scoring.Recipe("logistic", params={"maxIter": 5}))
    row = prepared.view("all", train).limit(1).withColumn("c", F.lit(prepared.levels["c"]))
    stage = model.model.stages[0].transform(scoring._tagged(row, ROLES, prepared.levels))
    v = stage.select("_hot_c").first()[0]
    assert v.size == 3 and v.numNonzeros() == 0


@pytest.mark.parametrize("family,params", [("forest", {"numTrees": 5, "maxDepth": 3}), ("boost_gain", {"rounds": 9, "depth": 2}), ("boost_leaf", {"rounds": 9, "depth": 2, "min_rows": 5}), ("boost_plain", {"rounds": 9, "depth": 2})])
def test_tree_families_learn(spark, cases, family, params):
    from scorelab.operators.metrics import ranking_metrics

    train, test = F.col("part") == "train", F.col("part") == "test"
    prepared = scoring.prepare(cases, ROLES, None, train)
    model, scored = scoring.final_scores(prepared, scoring.Recipe(family, "SMOTE", params=params), train, test)
    assert ranking_metrics(scored, []).first()["AUROC"] > 0.6
    assert {n for n, _ in model.importances()} == set(ROLES.inputs)


def test_draws_are_seeded_and_distinct():
    a, b = scoring.draw_params("boost_gain", 12, 1), scoring.draw_params("boost_gain", 12, 1)
    assert a == b and len({str(x) for x in a}) == 12 and a != scoring.draw_params("boost_gain", 12, 2)
    assert len(scoring.draw_params("logistic", 12, 1)) == 7


def test_header_is_the_first_line_of_each_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.asc").write_text("h1 h2\n" + "".join(f"{i} {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        out = readers.read_whitespace(spark, str(tmp_path), ["x", "y"])
        assert out.count() == 6000 and out.where("x IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_an_earlier_attempt_go(spark, tmp_path):
    root = str(tmp_path / "again")
    df = spark.createDataFrame([("r=1", 1.0), ("r2", 2.0)], "run_id string, v double")
    sinks.retract_runs(spark, root, ["r=1", "r2"])
    sinks.write_run_table(df, root, "m")
    sinks.complete_runs(spark, root, {"r=1": "s", "r2": "s"})
    sinks.retract_runs(spark, root, ["r=1"])
    sinks.write_run_table(df.limit(0), root, "m")
    sinks.complete_runs(spark, root, {"r=1": "s"})
    assert [r["run_id"] for r in sinks.read_complete(spark, root, "m").collect()] == ["r2"]


def test_checksums_of_files_of_any_size(spark, tmp_path):
    """A sparse file above the 2 GB that one binary value can hold, beside a small and an empty one."""
    import hashlib

    size = (2 << 30) + 12_345
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"left out")
    zeros, whole, left = bytes(8 << 20), hashlib.sha256(), size
    while left:
        whole.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    found = {r["file"]: (r["bytes"], r["sha256"]) for r in readers.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert found == {"big.bin": (size, whole.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "none.bin": (0, hashlib.sha256(b"").hexdigest())}


def test_run_record_names_the_engine(spark):
    r = sinks.run_record(spark, {"b": "2", "a": "1"}, readers.fingerprint(spark.range(3))).first()
    assert r["options"] == {"a": "1", "b": "2"} and r["spark_version"] == spark.version and r["n_rows"] == 3


def test_scores_are_fitted_once(spark, cases, tmp_path):
    folds = scoring.Folds.partition("fold", 3)
    prepared, root = scoring.prepare(cases, ROLES, folds), str(tmp_path / "store")
    recipes = {"x": scoring.Recipe("logistic", params={"maxIter": 5}), "y": scoring.Recipe("boost_plain", params={"rounds": 3, "depth": 2})}
    first, fitted = scoring.oof_from_store(prepared, folds, recipes, root)
    assert len(fitted) == 6 and first.count() == 2 * cases.count()
    again, none = scoring.oof_from_store(prepared, folds, recipes, root)
    assert none == [] and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    more = recipes | {"z": scoring.Recipe("logistic", "ClassWeight", params={"maxIter": 5})}
    assert {k for k, _ in scoring.oof_from_store(prepared, folds, more, root)[1]} == {"z"}

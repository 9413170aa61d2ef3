"""Queries for sources, cleaning, labels, partitions and fitted statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.functions.numeric import floor_days
from scorelab.operators import features, labels, metrics, prep, splits, thresholds
from scorelab.plans.base import (
    SQL_LABELS, SQL_LOANS, SQL_SCORES, loans, query, r, scores, table, tidy, with_sql,
)
from scorelab.session import materialised, scratch_path
from scorelab.sources import readers, sinks

HORIZON = 12
CUTOFFS = ["1997-01", "1998-01", "1999-01", "2000-01"]
LABELLED = with_sql(SQL_LOANS, SQL_LABELS)


def cases(spark, d):
    """Labelled, uncensored loans with the date their label is known."""
    labelled = labels.horizon_label(loans(spark, d), HORIZON).where(F.col("y") >= 0)
    return labelled.withColumn("observable_by", labels.observable_by(F.col("orig"), HORIZON))


SQL_CASES = SQL_LOANS + ",\n" + SQL_LABELS + """,
cases AS (SELECT *, orig + INTERVAL 12 MONTH AS observable_by FROM labelled WHERE y >= 0)"""


# --- sources --------------------------------------------------------------------


@query("delimited_read", "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def delimited_read(spark, d):
    names = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    src = table(spark, d, "lineitem").select(*names)
    path = scratch_path(spark, "delimited")
    sinks.export_csv(src, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema.fields])
    return readers.read_delimited(spark, path, schema)


@query("whitespace_read", """SELECT l_orderkey::DOUBLE AS a, l_partkey::DOUBLE AS b, l_quantity AS c, l_extendedprice AS d, l_discount AS e FROM lineitem""")
def whitespace_read(spark, d):
    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
    text = table(spark, d, "lineitem").select(F.concat_ws("  ", *cols).alias("value"))
    return readers.split_whitespace(text, list("abcde"))


@query("percent_columns", f"""SELECT l_quantity AS quantity, {r('(round(l_discount * 100))::DOUBLE', 'int_rate')}, l_tax AS revol_util
FROM lineitem WHERE l_returnflag <> 'N'""")
def percent_columns(spark, d):
    li = table(spark, d, "lineitem")
    sample = li.select(
        F.col("l_quantity").alias("quantity"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("int_rate"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("revol_util"),
        F.col("l_shipdate").alias("issue_date"),
        F.col("l_orderkey").alias("loan_csv_row"),
    )
    return readers.clean_club_sample(sample)


@query("first_per_key", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def first_per_key(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return tidy(readers.first_per_key(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]))


@query("file_checksums")
def file_checksums(spark, d):
    return readers.file_checksums(spark, d, "*.parquet")


HASHED = "('0x' || substr(md5({}), 1, 15))::BIGINT"
LINE_TEXT = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))"


@query("table_fingerprint", f"""SELECT count(*) AS n_rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor,
  'struct<l_orderkey:bigint,l_linenumber:bigint,l_partkey:bigint,l_suppkey:bigint,l_returnflag:string,l_linestatus:string,l_shipdate:string>' AS schema
FROM (SELECT {HASHED.format(LINE_TEXT)} AS h FROM lineitem)""")
def table_fingerprint(spark, d):
    keys = [F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    shipped = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("l_shipdate")
    return readers.fingerprint(table(spark, d, "lineitem").select(*keys, "l_returnflag", "l_linestatus", shipped), "md5")


@query("run_record", f"""SELECT '12' AS horizon_months, '6' AS test_window_months, count(*) AS n_rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor
FROM (SELECT {HASHED.format("concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)")} AS h FROM orders)""")
def run_record(spark, d):
    """The options and the input's fingerprint of a run, one column each (the engine's version is checked by a test)."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    record = sinks.run_record(spark, {"horizon_months": "12", "test_window_months": "6"}, readers.fingerprint(rows, "md5"))
    options = [F.col("options")[o].alias(o) for o in ("horizon_months", "test_window_months")]
    return record.select(*options, "n_rows", "hash_sum", "hash_xor")


@query("saved_files_by_glob", """SELECT 'run_' || l_linestatus || l_returnflag AS run_id, l_linestatus AS status, count(*) AS n, sum(l_orderkey)::BIGINT AS keys
FROM lineitem GROUP BY ALL""")
def saved_files_by_glob(spark, d):
    """Every run saves its own files below its folder; one glob reads them all, the folder names the run."""
    root = scratch_path(spark, "saved")
    li = table(spark, d, "lineitem").withColumn("run_id", F.concat(F.lit("run_"), "l_linestatus", "l_returnflag"))
    per_run = materialised(li.groupBy("run_id", F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")))
    for r in per_run.select("run_id").distinct().collect():
        sinks.write_new(per_run.where(F.col("run_id") == r["run_id"]).drop("run_id"), f"{root}/{r['run_id']}/results", "json")
    return tidy(readers.read_saved_runs(spark, f"{root}/*/results/*.json", schema="status string, n long, keys long"))


@query("summary_rewritten", "SELECT o_orderstatus AS status, count(*) AS n, count(*) * 2 AS twice FROM orders GROUP BY ALL")
def summary_rewritten(spark, d):
    """A summary over all runs replaces the stale one, whose rows and columns are gone."""
    root = scratch_path(spark, "summary")
    per = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_summary(per.withColumns({"stale": F.lit(1), "n": F.lit(0)}).union(per.withColumns({"stale": F.lit(2), "n": F.lit(0)})), root, "s")
    sinks.write_summary(per.withColumn("twice", F.col("n") * 2), root, "s")
    return tidy(spark.read.parquet(f"{root}/s"))


@query("csv_export", "SELECT o_orderstatus AS status, count(*) AS n, true AS refused FROM orders GROUP BY ALL")
def csv_export(spark, d):
    """A table goes to a new path with a header and comes back; an existing path is refused."""
    path = scratch_path(spark, "export")
    per = materialised(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")))
    sinks.export_csv(per, path)
    try:
        sinks.export_csv(per.limit(0), path)
        refused = False
    except AnalysisException as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    back = readers.read_delimited(spark, path)
    return tidy(back.select("status", F.col("n").cast("long").alias("n"), F.lit(refused).alias("refused")))


@query("saved_runs_roundtrip", """SELECT 'run_' || l_linestatus AS run_id, count(*) AS n, round(avg(l_discount), 8) + 0.0 AS mean_discount
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_linestatus""")
def saved_runs_roundtrip(spark, d):
    """Two runs are written, one completes; readers see the completed one."""
    root = scratch_path(spark, "runs")
    li = table(spark, d, "lineitem").withColumn("run_id", F.concat(F.lit("run_"), "l_linestatus"))
    per_run = li.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean_discount"))
    sinks.retract_runs(spark, root, ["run_F", "run_O"])
    sinks.write_run_table(per_run, root, "run_means")
    sinks.complete_runs(spark, root, {"run_F": "horizon=12"})
    return tidy(sinks.read_complete(spark, root, "run_means"))


@query("score_table", with_sql(SQL_SCORES) + f"SELECT run_id, model, row_id, y::BIGINT AS y, {r('p', 'p', 10)} FROM scores")
def score_table(spark, d):
    return tidy(scores(spark, d), digits=10)


# --- cleaning -------------------------------------------------------------------


@query("recode_levels", """SELECT c_custkey, CASE WHEN c_nationkey IN (0, 5, 6) THEN 4 ELSE c_nationkey END::BIGINT AS education,
  CASE WHEN c_nationkey % 4 = 0 THEN 3 ELSE c_nationkey % 4 END::BIGINT AS marriage FROM customer""")
def recode_levels(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("education"), (F.col("c_nationkey") % 4).alias("marriage")
    )
    return tidy(features.recode_levels(c, {"education": {0: 4, 5: 4, 6: 4}, "marriage": {0: 3}}))


@query("recode_target", "SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END::BIGINT AS y FROM labels")
def recode_target(spark, d):
    return tidy(labels.recode_target(table(spark, d, "labels"), "quality").select("doc_id", "y"))


CLEAN = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS "TotalProsperLoans",
  CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 5 END::DOUBLE AS "IncomeRange",
  (o_orderstatus = 'F')::BIGINT AS "IsBorrowerHomeowner", CASE WHEN o_orderstatus = 'O' THEN 'Unknown' ELSE o_orderpriority END AS "Occupation",
  CASE WHEN o_custkey % 60 <= 25 THEN 1 ELSE 2 END::BIGINT AS age_group, strftime(o_orderdate, '%Y-%m') AS month
FROM orders"""


@query("clean_loans", CLEAN)
def clean_loans(spark, d):
    """Prior-loan fill, income band, text flags, unknown fill, leakage drop, age group, month key."""
    o = table(spark, d, "orders")
    band = F.when(F.col("o_orderpriority") == "1-URGENT", "$0").when(
        F.col("o_orderpriority") == "2-HIGH", "$25,000-49,999"
    ).when(F.col("o_orderpriority") == "3-MEDIUM", "$100,000+").otherwise("Not displayed")
    raw = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("TotalProsperLoans"),
        features.ordinal_band(band).alias("IncomeRange"),
        features.text_flag(F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "False")).alias("IsBorrowerHomeowner"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("Occupation"),
        features.age_group(F.col("o_custkey") % 60).alias("age_group"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month"),
        F.col("o_totalprice").alias("BorrowerAPR"),
        F.col("o_orderstatus").alias("LoanStatus"),
    )
    prior = [c for c in features.PRIOR_LOAN_COLUMNS if c in raw.columns]
    return tidy(features.drop_leakage(raw.na.fill(0.0, prior).na.fill("Unknown", ["Occupation"])))


PERIODS = 6


def periods(spark, d):
    """One row per customer: balances, payments and delay statuses of the six newest years with orders.

    Period 5 is the newest year. A customer without orders has zeros.
    """
    o, year = table(spark, d, "orders"), F.year("o_orderdate")
    newest = o.agg(F.max(year)).first()[0] or 0
    YEARS = range(newest - PERIODS + 1, newest + 1)
    sums = o.groupBy("o_custkey").agg(
        *[F.sum(F.when(year == y, F.col("o_totalprice")).otherwise(0.0)).alias(f"bill_{i}") for i, y in enumerate(YEARS)],
        *[
            F.sum(F.when((year == y) & (F.col("o_orderstatus") == "F"), F.col("o_totalprice")).otherwise(0.0)).alias(f"pay_{i}")
            for i, y in enumerate(YEARS)
        ],
        *[
            (F.count_if((year == y) & (F.col("o_orderstatus") == "P")) - 1).alias(f"late_{i}")
            for i, y in enumerate(YEARS)
        ],
    )
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 100.0).alias("credit_limit"))
    both = c.join(sums, c.c_custkey == sums.o_custkey, "left").drop("o_custkey")
    none = {f"late_{i}": -1 for i in range(PERIODS)} | {f"{x}_{i}": 0.0 for x in ("bill", "pay") for i in range(PERIODS)}
    return both.na.fill(none)


def _sql_periods():
    years = [f"(SELECT max(year(o_orderdate)) - {PERIODS - 1 - i} FROM orders)" for i in range(PERIODS)]
    cols = [f"sum(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice ELSE 0 END) AS b{i}" for i, y in enumerate(years)]
    cols += [
        f"sum(CASE WHEN year(o_orderdate) = {y} AND o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS p{i}"
        for i, y in enumerate(years)
    ]
    cols += [
        f"least(greatest(count(*) FILTER (year(o_orderdate) = {y} AND o_orderstatus = 'P') - 1, 0), 8)::DOUBLE AS d{i}"
        for i, y in enumerate(years)
    ]
    def total(x):
        return "(" + " + ".join(f"{x}{i}" for i in range(6)) + ")"

    def slope(x):
        return "(" + " + ".join(f"{x}{i} * ({i - 2.5})" for i in range(6)) + ") / 17.5::DOUBLE"

    shares = " + ".join(f"CASE WHEN b{i} > 0 THEN p{i} / b{i} ELSE 0 END" for i in range(6))
    late = ", ".join(f"d{i}" for i in range(6))
    return f"""WITH s AS (SELECT o_custkey, {", ".join(cols)} FROM orders GROUP BY o_custkey),
t AS (SELECT c_custkey, c_acctbal * 100.0::DOUBLE AS lim, {", ".join(f"coalesce({x}{i}, 0) AS {x}{i}" for x in "bpd" for i in range(PERIODS))}
  FROM customer LEFT JOIN s ON c_custkey = o_custkey)
SELECT c_custkey, {r(f"{total('b')} / 6 / greatest(lim, 1)", 'util_rate_mean', 5)}, {r(f'({shares}) / 6', 'pay_ratio_mean')},
  {r(f"{total('d')} / 6", 'avg_pay_delay')}, {r(f'greatest({late})', 'max_pay_delay')}, {r(slope('b'), 'bill_trend', 4)},
  {r(slope('p'), 'pay_trend', 4)}, {r(f"lim / greatest({total('b')} / 6, 1)", 'limit_ratio', 5)},
  (d0 > (d1 + d2 + d3 + d4 + d5) / 5)::BIGINT AS delay_spike FROM t"""


FEATURES = ["util_rate_mean", "pay_ratio_mean", "avg_pay_delay", "max_pay_delay", "bill_trend", "pay_trend", "limit_ratio", "delay_spike"]


@query("period_features", _sql_periods())
def period_features(spark, d):
    six = [[f"{x}_{i}" for i in range(6)] for x in ("bill", "pay", "late")]
    out = features.period_features(periods(spark, d), "credit_limit", *six)
    return tidy(out.select("c_custkey", *FEATURES), util_rate_mean=5, bill_trend=4, pay_trend=4, limit_ratio=5)


@query("credit_history_years", f"""SELECT o_orderkey, {r("floor(date_diff('second', c.first, o_orderdate) / 86400.0::DOUBLE) / 365.25::DOUBLE", 'years')}
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) + INTERVAL 12 HOUR AS first FROM lineitem GROUP BY l_orderkey) c ON o_orderkey = l_orderkey""")
def credit_history_years(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_shipdate") + F.make_interval(hours=F.lit(12))).alias("first")
    )
    o = table(spark, d, "orders")
    j = o.join(first, o.o_orderkey == first.l_orderkey)
    return tidy(j.select("o_orderkey", labels.credit_history_years(F.col("o_orderdate"), F.col("first")).alias("years")))


# --- labels and partitions --------------------------------------------------------


@query("horizon_labels", LABELLED + "SELECT row_id, y::BIGINT AS y FROM labelled")
def horizon_labels(spark, d):
    return tidy(labels.horizon_label(loans(spark, d), HORIZON).select("row_id", "y"))


@query("label_observable_by", with_sql(SQL_CASES) + "SELECT row_id, strftime(observable_by, '%Y-%m-%d') AS observable_by FROM cases")
def label_observable_by(spark, d):
    return cases(spark, d).select("row_id", F.date_format("observable_by", "yyyy-MM-dd").alias("observable_by"))


SQL_ROLLING = SQL_CASES + """,
cuts AS (SELECT c AS cutoff, (c || '-01')::TIMESTAMP AS cut FROM (VALUES """ + ", ".join(f"('{c}')" for c in CUTOFFS) + """) v(c)),
rolled AS (
  SELECT cases.*, cutoff, cut, CASE WHEN observable_by <= cut THEN 'train' ELSE 'test' END AS part
  FROM cases JOIN cuts ON observable_by <= cut OR (orig >= cut AND orig < cut + INTERVAL 6 MONTH))"""


@query("rolling_origin_split", with_sql(SQL_ROLLING) + "SELECT cutoff, part, row_id, y::BIGINT AS y FROM rolled")
def rolling_origin_split(spark, d):
    return tidy(splits.rolling_origin(cases(spark, d), CUTOFFS).select("cutoff", "part", "row_id", "y"))


OUTSIDE = "1980-01"  # a cutoff before all data


@query("split_guards", with_sql(SQL_ROLLING) + f""", asked AS (SELECT cutoff, cut FROM cuts UNION ALL SELECT '{OUTSIDE}', '{OUTSIDE}-01'::TIMESTAMP),
sized AS (
  SELECT a.cutoff, a.cut, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test
  FROM asked a LEFT JOIN rolled r ON a.cutoff = r.cutoff GROUP BY a.cutoff, a.cut)
SELECT cutoff, n_train, n_test,
  CASE WHEN n_train = 0 OR n_test = 0 THEN 'empty_part'
       WHEN cut + INTERVAL 18 MONTH > (SELECT snapshot FROM snap) THEN 'test_labels_not_observable' ELSE 'ok' END AS status
FROM sized""")
def split_guards(spark, d):
    asked = [*CUTOFFS, OUTSIDE]
    s = splits.rolling_origin(cases(spark, d), asked)
    return tidy(splits.split_guards(s, asked, labels.snapshot_of(loans(spark, d)), HORIZON))


@query("split_summary", with_sql(SQL_ROLLING) + f"""SELECT cutoff, part, count(*) AS n, {r('avg(y)', 'default_rate')},
  strftime(min(orig), '%Y-%m-%d') AS first_orig, strftime(max(orig), '%Y-%m-%d') AS last_orig FROM rolled GROUP BY cutoff, part""")
def split_summary(spark, d):
    return tidy(splits.split_summary(splits.rolling_origin(cases(spark, d), CUTOFFS), ["cutoff", "part"]))


def hashed(seed, column):
    return f"(('0x' || substr(md5('{seed}|' || {column}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


RANKED = f"""ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {hashed(42, 'row_id')}, row_id) AS rn,
  count(*) OVER (PARTITION BY y) AS n FROM cases)"""


@query("stratified_split", with_sql(SQL_CASES, RANKED) + "SELECT row_id, y::BIGINT AS y, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ranked")
def stratified_split(spark, d):
    return tidy(splits.stratified_split(cases(spark, d)))


@query("stratified_folds", with_sql(SQL_CASES, RANKED) + "SELECT row_id, y::BIGINT AS y, (rn - 1) % 5 AS fold FROM ranked")
def stratified_folds(spark, d):
    return tidy(splits.stratified_folds(cases(spark, d)))


@query("early_stopping_slice", with_sql(SQL_CASES, RANKED) + "SELECT row_id, y::BIGINT AS y, rn <= round(n * 0.1::DOUBLE) AS is_stop, true AS has_slice FROM ranked")
def early_stopping_slice(spark, d):
    return tidy(splits.early_stopping_slice(cases(spark, d)))


@query("exact_sample", with_sql(SQL_CASES) + f"SELECT row_id, y::BIGINT AS y FROM cases ORDER BY {hashed(500, 'row_id')}, row_id LIMIT 2000")
def exact_sample(spark, d):
    return tidy(splits.exact_sample(cases(spark, d), 2000, 500).select("row_id", "y"))


SQL_FORWARD = SQL_CASES + """,
avail AS (
  SELECT row_id, y, date_trunc('month', orig)::TIMESTAMP AS month,
         greatest(date_trunc('month', orig) + INTERVAL 1 MONTH,
                  CASE WHEN date_trunc('month', observable_by) = observable_by THEN observable_by
                       ELSE date_trunc('month', observable_by) + INTERVAL 1 MONTH END)::TIMESTAMP AS avail FROM cases),
months AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx, count(*) OVER () AS nm FROM (SELECT DISTINCT month FROM avail)),
ready AS (
  SELECT m.*, (SELECT count(*) FILTER (a.y = 0) FROM avail a WHERE a.avail <= m.month) AS c0,
         (SELECT count(*) FILTER (a.y = 1) FROM avail a WHERE a.avail <= m.month) AS c1 FROM months m),
started AS (SELECT *, min(idx) FILTER (idx >= greatest(1, nm // 4) AND least(c0, c1) >= 6) OVER () AS start FROM ready),
blocks AS (SELECT month, nm - start AS n_used, ntile(3) OVER (ORDER BY month) AS fold FROM started WHERE idx >= start),
folds AS (SELECT fold, month, min(month) OVER (PARTITION BY fold) AS boundary, n_used FROM blocks)"""


@query("forward_folds", with_sql(SQL_FORWARD) + "SELECT fold, strftime(month, '%Y-%m') AS month, strftime(boundary, '%Y-%m') AS boundary, n_used FROM folds")
def forward_folds(spark, d):
    f = splits.forward_folds(cases(spark, d))
    return tidy(f.withColumns({c: F.date_format(c, "yyyy-MM") for c in ("month", "boundary")}))


@query("forward_membership", with_sql(SQL_FORWARD) + """SELECT fold, row_id, y::BIGINT AS y, 'validation' AS part FROM avail JOIN folds USING (month)
UNION ALL SELECT fold, row_id, y, 'train' FROM avail a JOIN (SELECT DISTINCT fold, boundary FROM folds) b ON a.avail <= b.boundary""")
def forward_membership(spark, d):
    c = cases(spark, d)
    return tidy(splits.forward_membership(c, splits.forward_folds(c)))


@query("imbalance_statistics", with_sql(SQL_ROLLING) + """SELECT cutoff, count(*) AS n_total, count(*) FILTER (y = 0) AS n_majority, count(*) FILTER (y = 1) AS n_minority,
  round_even(count(*) FILTER (y = 0)::DOUBLE / count(*) FILTER (y = 1), 4) AS imbalance_ratio,
  round_even(count(*) FILTER (y = 1)::DOUBLE / count(*) * 100.0::DOUBLE, 2) AS minority_pct FROM rolled WHERE part = 'train' GROUP BY cutoff""")
def imbalance_statistics(spark, d):
    s = splits.rolling_origin(cases(spark, d), CUTOFFS).where(F.col("part") == "train")
    return tidy(labels.imbalance_statistics(s, ["cutoff"]))


@query("class_weights", with_sql(SQL_ROLLING) + f"""SELECT cutoff, {r('count(*) FILTER (y = 0)::DOUBLE / greatest(count(*) FILTER (y = 1), 1)', 'positive_weight')},
  {r('count(*)::DOUBLE / (2 * count(*) FILTER (y = 0))', 'balanced_weight_0')}, {r('count(*)::DOUBLE / (2 * count(*) FILTER (y = 1))', 'balanced_weight_1')}
FROM rolled WHERE part = 'train' GROUP BY cutoff""")
def class_weights(spark, d):
    s = splits.rolling_origin(cases(spark, d), CUTOFFS).where(F.col("part") == "train")
    return tidy(labels.positive_class_weight(s, ["cutoff"]))


# flagship: label -> split -> threshold on train -> judge on test, all cutoffs in one job


def evaluated(spark, d):
    p = (F.col("o_totalprice") / (F.col("o_totalprice") + 150000.0)).alias("p")
    s = splits.rolling_origin(cases(spark, d), CUTOFFS).select("cutoff", "part", "row_id", "y", p)
    best = thresholds.optimal_thresholds(s.where(F.col("part") == "train"), ["cutoff"], ["f1"])
    return metrics.metric_rows(s.where(F.col("part") == "test"), ["cutoff"], best.select("cutoff", "threshold"))


SQL_EVALUATED = with_sql(SQL_ROLLING) + """, s AS (SELECT cutoff, part, row_id, y, o_totalprice / (o_totalprice + 150000.0::DOUBLE) AS p FROM rolled),
grid AS (SELECT i, 0.01::DOUBLE + i * 0.01::DOUBLE AS t FROM range(98) g(i)),
pts AS (SELECT cutoff, i, t, (count(*) FILTER (p >= t AND y = 1))::DOUBLE AS tp, (count(*) FILTER (p >= t AND y = 0))::DOUBLE AS fp,
  (count(*) FILTER (p < t AND y = 1))::DOUBLE AS fn, (count(*) FILTER (p < t AND y = 0))::DOUBLE AS tn FROM s, grid WHERE part = 'train' GROUP BY ALL),
sc AS (SELECT *, tp / (tp + fp + 1e-10::DOUBLE) AS prec, tp / (tp + fn + 1e-10::DOUBLE) AS sens FROM pts),
best AS (SELECT cutoff, t FROM sc QUALIFY row_number() OVER (PARTITION BY cutoff ORDER BY 2.0::DOUBLE * prec * sens / (prec + sens + 1e-10::DOUBLE) DESC, i) = 1),
c AS (SELECT cutoff, p, sum(y) AS pos, sum(1 - y) AS neg FROM s WHERE part = 'test' GROUP BY ALL),
cv AS (SELECT *, coalesce(sum(pos) OVER w, 0)::DOUBLE AS pb, coalesce(sum(neg) OVER w, 0)::DOUBLE AS nb, (sum(pos) OVER (PARTITION BY cutoff))::DOUBLE AS np,
  (sum(neg) OVER (PARTITION BY cutoff))::DOUBLE AS nn FROM c WINDOW w AS (PARTITION BY cutoff ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rk AS (SELECT cutoff, sum(pos * (nb + 0.5::DOUBLE * neg) / (np * nn)) AS auroc, sum(pos / np * (np - pb) / (np - pb + nn - nb)) AS auprc FROM cv GROUP BY ALL),
cf AS (SELECT cutoff, t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn,
  count(*) FILTER (p < t AND y = 0) AS tn, avg((p - y) * (p - y)) AS brier FROM s JOIN best USING (cutoff) WHERE part = 'test' GROUP BY ALL)
"""


@query("rolling_origin_evaluation", SQL_EVALUATED + f"""SELECT cutoff, {r('auroc', 'AUROC')}, {r('auprc', 'AUPRC')}, {r('brier', 'Brier')},
  {r('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 'F1')}, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", {r('t', 'threshold')}
FROM cf JOIN rk USING (cutoff)""")
def rolling_origin_evaluation(spark, d):
    return tidy(evaluated(spark, d).select("cutoff", "AUROC", "AUPRC", "Brier", "F1", "TP", "FP", "FN", "TN", "threshold"))


# --- fitted statistics --------------------------------------------------------------

CONTINUOUS = ["total", "balance", "months"]
NOMINALS = ["segment", "priority"]


def loan_features(spark, d):
    """Uncensored loans with two incomplete and one complete feature, two nominals, five folds."""
    c = table(spark, d, "customer")
    cs = cases(spark, d)
    return cs.join(c, cs.o_custkey == c.c_custkey).select(
        "row_id",
        "y",
        "orig",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("total"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        floor_days(F.col("orig"), F.lit("1995-01-01").cast("timestamp")).alias("months"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("row_id") % 5).cast("int").alias("fold"),
    )


SQL_FEATURES = SQL_CASES + """,
feats AS (
  SELECT row_id, y, orig, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS total,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
         floor(date_diff('second', TIMESTAMP '1995-01-01', orig) / 86400.0::DOUBLE) AS months,
         nullif(c_mktsegment, 'FURNITURE') AS segment, o_orderpriority AS priority, row_id % 5 AS fold
  FROM cases JOIN customer ON o_custkey = c_custkey)"""


def quantile_sql(column, q):
    return f"quantile_cont({column}, {q}::DOUBLE)"


def _stats_sql(fits: str) -> str:
    """Long statistics for (fit, row) pairs given by ``fits``."""
    return f""", long AS (
  SELECT fit, 'total' AS feature, total AS v FROM {fits} UNION ALL SELECT fit, 'balance', balance FROM {fits} UNION ALL SELECT fit, 'months', months FROM {fits}),
med AS (SELECT fit, feature, coalesce(quantile_cont(v, 0.5::DOUBLE), 0) AS median, count(*) AS n, count(*) - count(v) AS n_missing FROM long GROUP BY ALL),
fill AS (SELECT fit, feature, coalesce(v, median) AS v FROM long JOIN med USING (fit, feature)),
bnd AS (SELECT fit, feature, quantile_cont(v, 0.01::DOUBLE) AS lower, quantile_cont(v, 0.99::DOUBLE) AS upper FROM fill GROUP BY ALL),
mom AS (SELECT fit, feature, avg(least(greatest(v, lower), upper)) AS mean, stddev_pop(least(greatest(v, lower), upper)) AS std
        FROM fill JOIN bnd USING (fit, feature) GROUP BY ALL),
stats AS (SELECT *, CASE WHEN std > 0 THEN std ELSE 1 END AS scale FROM med JOIN bnd USING (fit, feature) JOIN mom USING (fit, feature))
"""


STATS_OUT = f"""SELECT fit, feature, {r('median', 'median', 5)}, {r('lower', 'lower', 5)}, {r('upper', 'upper', 5)}, {r('mean', 'mean', 5)},
  {r('scale', 'scale', 5)}, n, n_missing FROM stats"""

SQL_ALL = with_sql(SQL_FEATURES) + ", allrows AS (SELECT 'all' AS fit, * FROM feats)" + _stats_sql("allrows")
SQL_FOLDS = with_sql(SQL_FEATURES) + ", foldrows AS (SELECT 'fold' || f AS fit, feats.* FROM feats JOIN range(5) g(f) ON fold <> f)" + _stats_sql("foldrows")


@query("prep_statistics", SQL_ALL + STATS_OUT)
def prep_statistics(spark, d):
    return tidy(prep.fit_statistics(loan_features(spark, d), CONTINUOUS, {"all": F.lit(True)}), digits=5)


@query("prep_statistics_per_fold", SQL_FOLDS + STATS_OUT)
def prep_statistics_per_fold(spark, d):
    fits = {f"fold{k}": F.col("fold") != k for k in range(5)}
    return tidy(prep.fit_statistics(loan_features(spark, d), CONTINUOUS, fits), digits=5)


def _scaled(c):
    return f"(least(greatest(coalesce({c}, {c}_s.median), {c}_s.lower), {c}_s.upper) - {c}_s.mean) / {c}_s.scale"


APPLIED = SQL_FOLDS + "SELECT row_id, " + ", ".join(r(_scaled(c), c, 6) for c in CONTINUOUS) + """,
  (total IS NULL)::BIGINT AS total_missing, (balance IS NULL)::BIGINT AS balance_missing, priority FROM feats
""" + "\n".join(f"JOIN stats {c}_s ON {c}_s.feature = '{c}' AND {c}_s.fit = 'fold' || fold" for c in CONTINUOUS)


@query("standardised_features", APPLIED)
def standardised_features(spark, d):
    """Each row prepared with the statistics of the fold that holds it out."""
    f = loan_features(spark, d)
    stats = prep.fit_statistics(f, CONTINUOUS, {f"fold{k}": F.col("fold") != k for k in range(5)})
    rows = f.withColumn("fit", F.concat(F.lit("fold"), F.col("fold").cast("string")))
    out = prep.apply_statistics(rows, stats, CONTINUOUS, ["total", "balance"], ["priority"], keep=["row_id"])
    return tidy(out, digits=6)


@query("winsor_bounds", with_sql(SQL_FEATURES) + f""", long AS (SELECT 'total' AS feature, total AS v FROM feats UNION ALL SELECT 'balance', balance FROM feats
  UNION ALL SELECT 'months', months FROM feats)
SELECT feature, {r(quantile_sql('v', 0.01), 'lower', 5)}, {r(quantile_sql('v', 0.99), 'upper', 5)} FROM long GROUP BY feature""")
def winsor_bounds(spark, d):
    return tidy(prep.winsor_bounds(loan_features(spark, d), CONTINUOUS), digits=5)


@query("winsorised_features", with_sql(SQL_FEATURES) + f""", b AS (SELECT {', '.join(f'{quantile_sql(c, 0.01)} AS {c}_lo, {quantile_sql(c, 0.99)} AS {c}_hi' for c in CONTINUOUS)} FROM feats)
SELECT row_id, {', '.join(r(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END', c, 5) for c in CONTINUOUS)} FROM feats, b""")
def winsorised_features(spark, d):
    f = loan_features(spark, d)
    out = prep.apply_winsor(f, prep.winsor_bounds(f, CONTINUOUS), CONTINUOUS)
    return tidy(out.select("row_id", *CONTINUOUS), digits=5)


@query("missing_columns", with_sql(SQL_FEATURES) + """SELECT 'total' AS feature, bool_or(total IS NULL) AS has_missing FROM feats
UNION ALL SELECT 'balance', bool_or(balance IS NULL) FROM feats UNION ALL SELECT 'months', bool_or(months IS NULL) FROM feats""")
def missing_columns(spark, d):
    return prep.missing_columns(loan_features(spark, d), CONTINUOUS)


@query("baseline_row", with_sql(SQL_FEATURES) + f"""SELECT 'total' AS feature, {r('median(total)', 'value', 5)} FROM feats UNION ALL SELECT 'balance', round(median(balance), 5) FROM feats
UNION ALL SELECT 'months', round(median(months), 5) FROM feats
UNION ALL (SELECT 'fold', fold::DOUBLE FROM feats GROUP BY fold ORDER BY count(*) DESC, fold LIMIT 1)""")
def baseline_row(spark, d):
    return tidy(prep.baseline_row(loan_features(spark, d), CONTINUOUS, ["fold"]), digits=5)


VOCAB = """, long AS (SELECT 'segment' AS feature, segment AS level FROM feats WHERE fold <> 0 AND priority <> '2-HIGH' UNION ALL
  SELECT 'priority', priority FROM feats WHERE fold <> 0 AND priority <> '2-HIGH'),
vocab AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS code, count(*) OVER (PARTITION BY feature) AS n_levels
  FROM (SELECT DISTINCT feature, level FROM long WHERE level IS NOT NULL))
"""


def _train_vocab(f):
    return prep.vocabulary(f.where((F.col("fold") != 0) & (F.col("priority") != "2-HIGH")), NOMINALS)


@query("nominal_vocabulary", with_sql(SQL_FEATURES) + VOCAB + "SELECT feature, level, code, n_levels FROM vocab")
def nominal_vocabulary(spark, d):
    return tidy(_train_vocab(loan_features(spark, d)))


@query("nominal_codes", with_sql(SQL_FEATURES) + VOCAB + """SELECT row_id, coalesce(a.code, (SELECT max(n_levels) FROM vocab WHERE feature = 'segment'))::BIGINT AS segment,
  coalesce(b.code, (SELECT max(n_levels) FROM vocab WHERE feature = 'priority'))::BIGINT AS priority FROM feats
LEFT JOIN vocab a ON a.feature = 'segment' AND a.level = segment LEFT JOIN vocab b ON b.feature = 'priority' AND b.level = priority""")
def nominal_codes(spark, d):
    f = loan_features(spark, d)
    return tidy(prep.encode(f, _train_vocab(f), NOMINALS).select("row_id", *NOMINALS))

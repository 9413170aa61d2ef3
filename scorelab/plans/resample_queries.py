"""Queries for neighbours and rebalancing on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import neighbours, resample
from scorelab.plans.base import query, r, table, tidy, with_sql


def points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        (F.col("label") < 2).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (F.col("label") % 2).alias("parity"),
        (F.col("vec_id") % 4).cast("int").alias("band"),
    )


SQL_POINTS = "pts AS (SELECT vec_id AS id, (label < 2)::INT AS y, embedding::DOUBLE[] AS vec, label % 2 AS parity, vec_id % 4 AS band FROM embeddings)"


def _nn(name, q, c, k):
    return f"""{name} AS (SELECT q.id AS query_id, c.id AS id, list_distance(q.vec, c.vec) AS dist,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, c.vec), c.id) AS rank
  FROM {q} q JOIN {c} c ON q.id <> c.id QUALIFY rank <= {k})"""


MIN = "mi AS (SELECT * FROM pts WHERE y = 1)"


@query("nearest_neighbours", with_sql(SQL_POINTS, _nn("nn", "pts", "pts", 5)) + f"SELECT query_id, id, rank, {r('dist', 'distance', 7)} FROM nn")
def nearest_neighbours(spark, d):
    p = points(spark, d)
    return tidy(neighbours.knn_join(p, p, 5, exclude_self=True), digits=7)


def _u(seed, expr):
    return f"(('0x' || substr(md5('{seed}|' || {expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _made(seeds, name="made"):
    return f"""need AS (SELECT greatest(count(*) FILTER (y = 0) - count(*) FILTER (y = 1), 0) AS n FROM pts),
bs AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS m FROM {seeds}),
plan AS (SELECT syn_id, {_u('42b', 'syn_id')} AS ub, {_u('42n', 'syn_id')} AS un, {_u('42g', 'syn_id')} AS gap FROM need, unnest(range(n)) g(syn_id)),
drawn AS (SELECT syn_id, bs.id AS base_id, floor(un * 5) + 1 AS rank, gap FROM plan JOIN bs ON rn = floor(ub * m) + 1),
{name} AS (SELECT syn_id, base_id, nn.id AS nn_id, gap, a.vec AS va, b.vec AS vb FROM drawn JOIN nn ON nn.query_id = base_id AND nn.rank = drawn.rank
  JOIN pts a ON a.id = base_id JOIN pts b ON b.id = nn.id)"""


def _first(step="gap"):
    return ", ".join(r(f"va[{i + 1}] + {step} * (vb[{i + 1}] - va[{i + 1}])", f"x{i}", 7) for i in range(64))


def _shown(df):
    return tidy(
        df.select("syn_id", "base_id", "nn_id", *[F.col("vec")[i].alias(f"x{i}") for i in range(64)]), digits=7
    )


@query("smote_rows", with_sql(SQL_POINTS, MIN, _nn("nn", "mi", "mi", 5), _made("mi")) + f"SELECT syn_id, base_id, nn_id, {_first()} FROM made")
def smote_rows(spark, d):
    return _shown(resample.smote(points(spark, d)))


ALLNN = _nn("an", "mi", "pts", 10) + ",\n" + "mc AS (SELECT query_id AS id, count(*) FILTER (y = 0) AS n_major, count(*) AS m FROM an JOIN pts USING (id) GROUP BY query_id)"
DANGER = "dg AS (SELECT id FROM mc WHERE n_major * 2 >= m AND n_major < m)"


@query("endangered_rows", with_sql(SQL_POINTS, MIN, ALLNN) + "SELECT id, n_major, m FROM mc WHERE n_major * 2 >= m AND n_major < m")
def endangered_rows(spark, d):
    return tidy(resample.danger_rows(points(spark, d)))


@query("borderline_smote_rows", with_sql(SQL_POINTS, MIN, _nn("nn", "mi", "mi", 5), ALLNN, DANGER, _made("dg")) + f"SELECT syn_id, base_id, nn_id, {_first()} FROM made")
def borderline_smote_rows(spark, d):
    return _shown(resample.borderline_smote(points(spark, d)))


QUOTA = with_sql(SQL_POINTS, MIN, _nn("an", "mi", "pts", 5)) + """, mc AS (SELECT query_id AS id, count(*) FILTER (y = 0)::DOUBLE / count(*) AS ra FROM an JOIN pts USING (id) GROUP BY query_id),
qt AS (SELECT id, round_even(ra / (SELECT sum(ra) FROM mc) * (SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) FROM pts), 0)::BIGINT AS quota FROM mc)
"""


@query("adasyn_quota", QUOTA + "SELECT id, quota FROM qt")
def adasyn_quota(spark, d):
    return tidy(resample.adasyn_quota(points(spark, d)))


@query("adasyn_rows", QUOTA + f", {_nn('nn', 'mi', 'mi', 5)}, " + f"""ex AS (SELECT id || '-' || i AS syn_id, id AS base_id FROM qt, unnest(range(quota)) g(i)),
dr AS (SELECT syn_id, base_id, floor({_u('42n', 'syn_id')} * 5) + 1 AS rank, {_u('42g', 'syn_id')} AS gap FROM ex),
made AS (SELECT syn_id, base_id, nn.id AS nn_id, gap, a.vec AS va, b.vec AS vb FROM dr JOIN nn ON nn.query_id = base_id AND nn.rank = dr.rank
  JOIN pts a ON a.id = base_id JOIN pts b ON b.id = nn.id)
SELECT syn_id, base_id, nn_id, {_first()} FROM made""")
def adasyn_rows(spark, d):
    return _shown(resample.adasyn(points(spark, d)))


@query("svm_smote_rows")
def svm_smote_rows(spark, d):
    return _shown(resample.svm_smote(points(spark, d)))


@query("nominal_votes", with_sql(SQL_POINTS, MIN, _nn("nn", "mi", "mi", 5), _made("mi")) + """, syn AS (
  SELECT syn_id, list_transform(list_zip(va, vb), lambda z: z[1] + gap * (z[2] - z[1])) AS vec FROM made),
vn AS (SELECT s.syn_id, o.id, o.parity, o.band, row_number() OVER (PARTITION BY s.syn_id ORDER BY list_distance(s.vec, o.vec), o.id) AS rank FROM syn s, mi o QUALIFY rank <= 5),
vl AS (SELECT syn_id, 'parity' AS f, parity AS code, rank FROM vn UNION ALL SELECT syn_id, 'band', band, rank FROM vn),
vc AS (SELECT syn_id, f, code, count(*) AS n, min(rank) AS fr FROM vl GROUP BY ALL),
vw AS (SELECT syn_id, f, code FROM vc QUALIFY row_number() OVER (PARTITION BY syn_id, f ORDER BY n DESC, (fr = 1) DESC, code) = 1)
SELECT syn_id AS id, max(code) FILTER (f = 'parity')::BIGINT AS parity, max(code) FILTER (f = 'band')::BIGINT AS band FROM vw GROUP BY syn_id""")
def nominal_votes(spark, d):
    p = points(spark, d)
    syn = resample.smote(p).select(F.col("syn_id").alias("id"), "vec")
    return tidy(resample.nominal_vote(syn, p.where("y = 1"), ["parity", "band"]))


@query("class_balance", with_sql(SQL_POINTS) + """SELECT 'before' AS stage, y::BIGINT AS y, count(*) AS n FROM pts GROUP BY y
UNION ALL SELECT 'after', g.y, (SELECT count(*) FROM pts WHERE y = 0) FROM (VALUES (0), (1)) g(y)""")
def class_balance(spark, d):
    """SMOTE on all dimensions with nominal votes: equal classes afterwards."""
    p = points(spark, d)
    names = [f"x{i}" for i in range(64)]
    train = p.select("id", "y", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)], "parity", "band")
    return tidy(resample.class_balance(train, resample.resample(train, "SMOTE", names, ["parity", "band"])))


@query("unresampled_rows", with_sql(SQL_POINTS) + "SELECT id::VARCHAR AS id, y::BIGINT AS y, " + ", ".join(f"round(vec[{i + 1}], 8) + 0.0 AS x{i}" for i in range(64)) + ", false AS is_synthetic FROM pts")
def unresampled_rows(spark, d):
    names = [f"x{i}" for i in range(64)]
    train = points(spark, d).select("id", "y", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)])
    return tidy(resample.resample(train, "ClassWeight", names))

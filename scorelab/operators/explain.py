"""Attributions as a long table (row_id, method, repeat, feature, value) and their quality."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorelab.functions.hashing import md5_uniforms, standard_normal, uniform
from scorelab.functions.numeric import ratio
from scorelab.operators.compare import spearman
from scorelab.operators.ordering import exact_quantiles
from scorelab.operators.robust import Scorer


# --- attributions ---------------------------------------------------------------


def linear_attributions(df: DataFrame, coefficients: Mapping[str, float], row_id: str = "row_id") -> DataFrame:
    """Exact additive attributions of a linear score: coefficient x (value - mean)."""
    names = list(coefficients)
    means = df.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in names]))
    part = {
        f: F.lit(float(coefficients[f])) * (F.col(f).cast("double") - F.col("_mean")[f]) for f in names
    }
    wide = df.withColumn("_mean", means.scalar()).select(row_id, *[c.alias(f) for f, c in part.items()])
    return wide.unpivot([row_id], names, "feature", "value")


def _spread(df: DataFrame, row_id: str) -> DataFrame:
    """Rows dealt by their id before each becomes very many: no task makes most of them, and a row's sums need no exchange."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), row_id)


def shapley_samples(
    df: DataFrame,
    baseline: Mapping[str, float],
    score: Scorer,
    permutations: int = 10,
    seed: int = 42,
    row_id: str = "row_id",
    method: str = "xxhash64",
) -> DataFrame:
    """Sampled Shapley values for any scorer: row_id, feature, value.

    Each (row, permutation) becomes features + 1 hybrid rows that move from the
    baseline to the row one feature at a time. All hybrids are scored in bulk and
    differenced where they are made. The attributions of a row sum to score(row) - score(baseline).
    """
    names = list(baseline)
    order = F.array_sort(
        F.array(
            *[F.struct(uniform(seed, row_id, "_perm", F.lit(f), method=method).alias("u"), F.lit(f).alias("f")) for f in names]
        )
    )
    perms = _spread(df, row_id).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn(
        "_order", F.transform(order, lambda x: x["f"])
    )
    steps = perms.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    hybrid = steps.withColumns(
        {
            f: F.when(F.array_position("_order", F.lit(f)) <= F.col("_step"), F.col(f).cast("double")).otherwise(
                F.lit(float(baseline[f]))
            )
            for f in names
        }
    )
    # a hybrid's score ends the step of one feature and begins the next one's: a permutation's scores meet by feature
    ended, begun = F.get("_order", F.col("_step") - 1), F.get("_order", F.col("_step"))
    ends = [F.max(F.when(at == f, F.col("p"))).alias(f"{end}{f}") for f in names for end, at in (("_a_", ended), ("_b_", begun))]
    sums = score(hybrid).groupBy(row_id, "_perm").agg(*ends).groupBy(row_id).agg(
        *[F.avg(F.col(f"_a_{f}") - F.col(f"_b_{f}")).alias(f"_v_{f}") for f in names]
    )
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_v_{f}").alias("value")) for f in names])
    return sums.select(row_id, F.explode(entries).alias("_e")).select(row_id, "_e.feature", "_e.value")


#: Samples that a task draws at once.
DRAWN = 16_384


def _md5_samples(df: DataFrame, means: Mapping[str, float], stds: Mapping[str, float], samples: int, seed: int, row_id: str) -> DataFrame:
    """The samples of ``_column_samples`` by MD5, hashed in blocks of many messages."""
    names = list(means)
    others = [c for c in df.columns if c not in names]
    name = F.coalesce(F.concat(F.lit("|"), F.col(row_id).cast("string")), F.lit(""))  # a missing key is left out
    ready = df.select(*[F.col(c) for c in others], *[F.col(f).cast("double").alias(f) for f in names], name.alias("_name"))
    step = max(1, DRAWN // samples)
    tails = {f: [f"|{m}|{f}".encode() for m in range(samples)] for f in names}

    def drawn(f: str, heads: list[bytes], at: int, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        kept = md5_uniforms([str(seed).encode() + h for h in heads], tails[f]) < 0.5
        kept[:, 0] = True
        u1, u2 = (md5_uniforms([f"{seed}n{part}".encode() + h for h in heads], tails[f], ~kept) for part in "ab")
        normal = np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2.0 * np.pi * u2)
        own = column.slice(at, len(heads))
        missing = own.is_null().to_numpy(zero_copy_only=False)
        value = np.where(kept, own.to_numpy(zero_copy_only=False)[:, None], float(means[f]) + float(stds[f]) * normal)
        return pa.array(value.reshape(-1), mask=(kept & missing[:, None]).reshape(-1)), pa.array(kept.reshape(-1).astype(float))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [x.encode() for x in batch.column("_name").to_pylist()]
            for at in range(0, len(heads), step):
                own = heads[at : at + step]
                rows = pa.array(np.repeat(np.arange(at, at + len(own)), samples))
                columns = {c: batch.column(c).take(rows) for c in others}
                for f in names:
                    columns[f], columns[f"_b_{f}"] = drawn(f, own, at, batch.column(f))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = [field for field in ready.schema.fields if field.name in others]
    numbers = [T.StructField(c, T.DoubleType()) for f in names for c in (f, f"_b_{f}")]
    return ready.mapInArrow(sample, T.StructType([*kept, *numbers]))


def _column_samples(
    df: DataFrame, means: Mapping[str, float], stds: Mapping[str, float], samples: int, seed: int, row_id: str, method: str
) -> DataFrame:
    """``samples`` rows for each row: flags ``_b_<feature>`` and the features, kept (1) or drawn (0). Sample 0 is the row."""
    names = list(means)
    many = df.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    flags = {
        f"_b_{f}": F.when((F.col("_m") == 0) | (uniform(seed, row_id, "_m", F.lit(f), method=method) < 0.5), 1.0).otherwise(0.0)
        for f in names
    }
    drawn = {
        f: F.lit(float(means[f])) + F.lit(float(stds[f])) * standard_normal(f"{seed}n", row_id, "_m", F.lit(f), method=method)
        for f in names
    }
    flagged = many.withColumns(flags)
    return flagged.withColumns(
        {f: F.when(F.col(f"_b_{f}") == 1.0, F.col(f).cast("double")).otherwise(drawn[f]) for f in names}
    )


def local_surrogate(
    df: DataFrame,
    means: Mapping[str, float],
    stds: Mapping[str, float],
    score: Scorer,
    samples: int = 200,
    ridge: float = 1.0,
    seed: int = 42,
    row_id: str = "row_id",
    method: str = "xxhash64",
) -> DataFrame:
    """Local weighted ridge per row on keep/replace flags: row_id, feature, value, r2.

    Samples are scored in bulk; the regression only needs grouped sums (normal
    equations), summed where the samples are made. The small solve per row
    runs in an Arrow function.
    """
    names = list(means)
    k = len(names)
    width = 0.75 * float(np.sqrt(k))
    spread = _spread(df, row_id)
    if method == "md5":
        sampled = _md5_samples(spread, means, stds, samples, seed, row_id)
    else:
        sampled = _column_samples(spread, means, stds, samples, seed, row_id, method)
    scored = score(sampled)
    off = F.lit(float(k))
    for f in names:
        off = off - F.col(f"_b_{f}")
    weighted = scored.withColumn("_w", F.exp(-off / F.lit(width * width)))
    w, p = F.col("_w"), F.col("p")
    terms = [F.lit(1.0)] + [F.col(f"_b_{f}") for f in names]
    gram = [F.sum(w * terms[i] * terms[j]) for i in range(k + 1) for j in range(i, k + 1)]
    sums = weighted.groupBy(row_id).agg(
        F.array(*gram).alias("gram"),
        F.array(*[F.sum(w * t * p) for t in terms]).alias("rhs"),
        F.sum(w * p * p).alias("yy"),
    )

    def solve(gram_s: pd.Series, rhs_s: pd.Series, yy_s: pd.Series) -> pd.DataFrame:
        rows = []
        upper = np.triu_indices(k + 1)
        for g, b, yy in zip(gram_s, rhs_s, yy_s):
            a = np.zeros((k + 1, k + 1))
            a[upper] = g
            a = a + a.T - np.diag(np.diag(a))
            b = np.asarray(b, dtype=float)
            penal = np.eye(k + 1) * ridge
            penal[0, 0] = 0.0
            beta = np.linalg.solve(a + penal, b)
            total = yy - b[0] * b[0] / a[0, 0]
            rest = yy - 2.0 * beta @ b + beta @ a @ beta
            rows.append((beta[1:].tolist(), None if total <= 1e-15 else float(1.0 - rest / total)))
        return pd.DataFrame(rows, columns=["coef", "r2"])

    out_type = T.StructType(
        [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType())]
    )
    fitted = sums.withColumn("_fit", F.pandas_udf(solve, out_type)("gram", "rhs", "yy"))
    entries = F.arrays_zip(F.array(*[F.lit(f) for f in names]).alias("feature"), F.col("_fit.coef").alias("value"))
    return fitted.select(row_id, F.col("_fit.r2").alias("r2"), F.explode(entries).alias("e")).select(
        row_id, F.col("e")["feature"].alias("feature"), F.col("e")["value"].alias("value"), "r2"
    )


# --- summaries --------------------------------------------------------------------


def global_ranking(attributions: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """Top features by mean |value|: keys, rank, feature, mean_abs (a top-k report)."""
    means = attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = means.withColumn("rank", F.row_number().over(w.orderBy(F.desc("mean_abs"), "feature")))
    return ranked.where(F.col("rank") <= k).select(*keys, "rank", "feature", "mean_abs")


def additivity(
    attributions: DataFrame,
    predictions: DataFrame,
    expected: float,
    tolerance: float = 0.05,
    row_id: str = "row_id",
) -> DataFrame:
    """Do attributions plus the expected value rebuild the prediction? n, mae, pass.

    Sums outside [0, 1] are read as log-odds. All rows are checked.
    """
    sums = attributions.groupBy(row_id).agg((F.sum("value") + F.lit(float(expected))).alias("_f"))
    logodds = sums.agg((F.max("_f") > 1.0) | (F.min("_f") < 0.0))
    rebuilt = F.when(F.col("_lo"), 1.0 / (1.0 + F.exp(-F.col("_f")))).otherwise(F.col("_f"))
    joined = sums.join(predictions.select(row_id, "p"), row_id).withColumn("_lo", logodds.scalar())
    out = joined.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(rebuilt - F.col("p"))).alias("mae"))
    return out.withColumn("pass", F.col("mae") < tolerance)


def agreement(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row_id",), min_shared: int = 3, digits: int | None = 4
) -> DataFrame:
    """Spearman correlation of |value| over features that both explain (b nonzero)."""
    on = [*keys, "feature"]
    shared = (
        a.select(*on, F.abs("value").alias("_a"))
        .join(b.where(F.col("value") != 0).select(*on, F.abs("value").alias("_b")), on)
    )
    rho = spearman(shared, list(keys), "_a", "_b")
    value = F.bround("rho", digits) if digits is not None else F.col("rho")
    return rho.where(F.col("n") >= min_shared).select(*keys, F.col("n").alias("n_shared"), value.alias("rho"))


def concentration(attributions: DataFrame, keys: Sequence[str], mass: float = 0.8) -> DataFrame:
    """Gini of |value| and the number of features that carry ``mass`` of it, per key."""
    w = Window.partitionBy(*keys)
    rows = attributions.select(*keys, "feature", F.abs("value").alias("_v")).withColumns(
        {
            "_i": F.row_number().over(w.orderBy("_v", "feature")),
            "_total": F.sum("_v").over(w),
            "_cum": F.sum("_v").over(
                w.orderBy(F.desc("_v"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_total").alias("_t"),
        F.sum(F.col("_i") * F.col("_v")).alias("_iv"),
        F.count_if(F.col("_cum") < F.lit(mass) * F.col("_total")).alias("_less"),
    )
    n, t = F.col("n"), F.col("_t")
    gini = (2.0 * F.col("_iv") - (n + 1) * t) / F.when(t > 0, n * t)
    return sums.select(
        *keys,
        F.when((t <= 0) | (n < 2), 0.0).otherwise(gini).alias("gini"),
        F.when(t <= 0, n).otherwise(F.least(F.col("_less") + 1, n)).alias("features_for_mass"),
    )


def repeat_stability(attributions: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """Mean pairwise Spearman and top-k Jaccard over repeats of each key.

    A key holds repeats x features rows; an undefined correlation counts as 0,
    and a single repeat, which has no pair, is perfectly stable.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "repeat").orderBy(F.desc(F.abs("value")), F.desc("feature"))
    rows = attributions.select(
        *keys, "repeat", "feature", F.abs("value").alias("v"), (F.row_number().over(w) <= top).alias("hit")
    )
    entry = F.struct("repeat", "v", "hit")
    per_feature = rows.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    pairs = F.flatten(
        F.transform(
            "_r",
            lambda a, i: F.transform(
                F.slice("_r", i + 2, F.size("_r")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    both = per_feature.select(*keys, "feature", F.explode(pairs).alias("x")).select(
        *keys,
        "feature",
        F.col("x.a.repeat").alias("repeat_a"),
        F.col("x.b.repeat").alias("repeat_b"),
        F.col("x.a.v").alias("_va"),
        F.col("x.b.v").alias("_vb"),
        F.col("x.a.hit").alias("_ha"),
        F.col("x.b.hit").alias("_hb"),
    )
    pair_keys = [*keys, "repeat_a", "repeat_b"]
    rho = spearman(both, pair_keys, "_va", "_vb").select(*pair_keys, F.coalesce("rho", F.lit(0.0)).alias("rho"))
    overlap = both.groupBy(*pair_keys).agg(
        ratio(F.count_if(F.col("_ha") & F.col("_hb")), F.greatest(F.count_if(F.col("_ha") | F.col("_hb")), F.lit(1))).alias("jaccard")
    )
    found = rho.join(overlap, pair_keys).groupBy(*keys).agg(F.avg("rho").alias("_rho"), F.avg("jaccard").alias("_jac"))
    if not keys:
        return found.select(F.coalesce("_rho", F.lit(1.0)).alias("stability_rho"), F.coalesce("_jac", F.lit(1.0)).alias("top_jaccard"))
    every = attributions.select(*keys).distinct()
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return every.alias("e").join(found.alias("f"), reduce(lambda a, b: a & b, same), "left").select(
        *[F.col(f"e.{k}") for k in keys],
        F.coalesce("_rho", F.lit(1.0)).alias("stability_rho"), F.coalesce("_jac", F.lit(1.0)).alias("top_jaccard"),
    )


def quality_table(
    main: DataFrame, local: DataFrame, repeats: DataFrame, fit: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Concentration of both methods, their agreement, repeat stability and local fit per row.

    ``fit`` has (row_id, r2); rows without it keep NULL.
    """
    keys = [row_id]
    a = concentration(main, keys).select(row_id, F.col("gini").alias("main_gini"), F.col("features_for_mass").alias("main_features"))
    b = concentration(local, keys).select(row_id, F.col("gini").alias("local_gini"), F.col("features_for_mass").alias("local_features"))
    rho = agreement(main, local, keys, digits=None).select(row_id, F.col("rho").alias("abs_rank_rho"))
    stable = repeat_stability(repeats, keys)
    return (
        a.join(b, row_id)
        .join(rho, row_id, "left")
        .join(stable, row_id, "left")
        .join(fit.select(row_id, F.col("r2").alias("local_r2")), row_id, "left")
    )


def top_features(attributions: DataFrame, fraction: float = 0.2, row_id: str = "row_id") -> DataFrame:
    """Names of the strongest max(1, round(fraction x features)) features per row."""
    w = Window.partitionBy(row_id)
    k = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.count(F.lit(1)).over(w), 0).cast("int"))
    ranked = attributions.select(
        row_id,
        "feature",
        F.row_number().over(w.orderBy(F.desc(F.abs("value")), F.desc("feature"))).alias("_r"),
        k.alias("_k"),
    )
    return ranked.where(F.col("_r") <= F.col("_k")).groupBy(row_id).agg(F.collect_set("feature").alias("top"))


def fidelity(
    df: DataFrame,
    attributions: DataFrame,
    baseline: DataFrame,
    features: Sequence[str],
    score: Scorer,
    fraction: float = 0.2,
    row_id: str = "row_id",
) -> DataFrame:
    """|change| when the top features are deleted, and when only they are kept.

    ``baseline`` is (feature, value). Three variants per row are scored in one pass.
    """
    neutral = baseline.agg(
        F.struct(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    )
    rows = df.join(top_features(attributions, fraction, row_id), row_id).withColumn("_base", neutral.scalar())
    variants = rows.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in ("full", "deleted", "inserted")])))

    def value(f: str) -> Column:
        is_top = F.array_contains("top", F.lit(f))
        swapped = ((F.col("_v") == "deleted") & is_top) | ((F.col("_v") == "inserted") & ~is_top)
        return F.when(swapped, F.col("_base")[f]).otherwise(F.col(f).cast("double"))

    scored = score(variants.withColumns({f: value(f) for f in features})).groupBy(row_id).agg(
        *[F.max(F.when(F.col("_v") == v, F.col("p"))).alias(f"_{v}") for v in ("full", "deleted", "inserted")]
    )
    return scored.select(
        row_id,
        F.abs(F.col("_full") - F.col("_deleted")).alias("comprehensiveness"),
        F.abs(F.col("_full") - F.col("_inserted")).alias("sufficiency"),
        F.col("_full").alias("full_probability"),
    )


def importance_comparison(a: DataFrame, b: DataFrame, k: int = 15) -> DataFrame:
    """Two importance tables (feature, value), each cut to its top k and scaled by its maximum."""
    one = Window.partitionBy("source")
    both = a.select(F.lit("attribution").alias("source"), "feature", "value").unionByName(
        b.select(F.lit("builtin").alias("source"), "feature", "value")
    )
    ranked = both.withColumn("rank", F.row_number().over(one.orderBy(F.desc("value"), "feature")))
    return ranked.where(F.col("rank") <= k).withColumn("scaled", ratio(F.col("value"), F.max("value").over(one)))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column; NULLs left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return moments.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")

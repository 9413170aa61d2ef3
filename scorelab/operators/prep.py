"""Statistics learnt from training rows and their application.

All fits (outer training part, every fold) are learnt together: a value count
table carries one count column per fit, so quantiles of all fits share a sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.functions.numeric import clip, lerp, ratio
from scorelab.operators.ordering import prefix_sums, quantiles_of_ranked, weighted_quantiles
from scorelab.session import checked_broadcast, materialised


def value_counts(df: DataFrame, features: Sequence[str], fits: Mapping[str, Column]) -> DataFrame:
    """feature, value, and per fit the number of training rows (NULL values kept)."""
    marks = {f"_in_{k}": F.coalesce(v, F.lit(False)).cast("long") for k, v in fits.items()}
    slim = df.select(
        *[F.col(c).cast("double").alias(c) for c in features], *[v.alias(k) for k, v in marks.items()]
    )
    long = slim.unpivot(list(marks), list(features), "feature", "value")
    return long.groupBy("feature", "value").agg(*[F.sum(m).alias(f"n_{m[4:]}") for m in marks])


def _bounds_after_filling(ranked: DataFrame, centre: DataFrame, weights: Mapping[str, str], quantiles: tuple[float, float]) -> DataFrame:
    """feature, fit, lower, upper: quantiles of the values with the missing ones filled by the median, without another sort.

    Filling puts ``n_missing`` equal values at one place of the order: positions below it stay, positions above
    it move up by that number. So an order statistic is the median or a known value at a position
    that ``ranked`` can tell.
    """
    long = F.explode(
        F.array(*[F.struct(F.lit(k).alias("fit"), F.col(w).alias("n"), F.col(f"{k}_before").alias("before")) for k, w in weights.items()])
    )
    # features x fits rows: bounded by parameters
    each = ranked.select("feature", "value", long.alias("_r")).select("feature", "value", "_r.*").where("n > 0")
    placed = each.join(F.broadcast(centre), ["feature", "fit"])
    counts = placed.groupBy("feature", "fit").agg(
        F.sum("n").alias("known"), F.sum(F.when(F.col("value") < F.col("median"), F.col("n")).otherwise(0)).alias("under")
    )
    total = F.coalesce("known", F.lit(0)) + F.col("n_missing")
    wanted = centre.join(counts, ["feature", "fit"], "left").where(total > 0).select(
        "feature", "fit", "median", "n_missing", F.coalesce("under", F.lit(0)).alias("under"),
        F.explode(F.array(*[F.struct(F.lit(x).alias("side"), ((total - 1) * F.lit(float(q))).alias("at"), (total - 1).alias("last")) for x, q in zip(("lower", "upper"), quantiles)])).alias("_q"),
    )
    low = F.floor("_q.at")
    ends = wanted.select(
        "feature", "fit", "median", "n_missing", "under", "_q.side", (F.col("_q.at") - low).alias("share"),
        F.explode(F.array(F.struct(F.lit(0).alias("end"), low.alias("at")), F.struct(F.lit(1).alias("end"), F.least(low + 1, F.col("_q.last")).alias("at")))).alias("_e"),
    ).select("*", "_e.*")
    after = F.col("at") >= F.col("under") + F.col("n_missing")
    # the place among the known values; a filled place has none
    place = F.when(F.col("at") < F.col("under"), F.col("at")).when(after, F.col("at") - F.col("n_missing"))
    asked = materialised(ends.select("feature", "fit", "side", "end", "share", "median", place.alias("place")))
    hit = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
    found = each.join(F.broadcast(asked.where(F.col("place").isNotNull())), ["feature", "fit"]).where(hit)
    values = asked.where(F.col("place").isNull()).select("feature", "fit", "side", "end", "share", F.col("median").alias("value")).unionByName(
        found.select("feature", "fit", "side", "end", "share", "value")
    )

    def end(i: int) -> Column:
        return F.max(F.when(F.col("end") == i, F.col("value")))

    both = values.groupBy("feature", "fit", "side").agg(lerp(end(0), end(1), F.max("share")).alias("value"))
    return both.groupBy("feature", "fit").agg(
        *[F.max(F.when(F.col("side") == x, F.col("value"))).alias(x) for x in ("lower", "upper")]
    )


def fit_statistics(
    df: DataFrame,
    features: Sequence[str],
    fits: Mapping[str, Column],
    quantiles: tuple[float, float] = (0.01, 0.99),
) -> DataFrame:
    """Per fit and feature: median, winsor bounds after imputation, mean and std after clipping.

    Rows: fit, feature, median, lower, upper, mean, scale, n, n_missing.
    """
    weights = {k: f"n_{k}" for k in fits}
    counts = materialised(value_counts(df, features, fits))
    # the one sort: every known value with the number of values below it, per fit
    ranked = materialised(prefix_sums(counts.where(F.col("value").isNotNull()), ["feature"], ["value"], weights))
    med = quantiles_of_ranked(ranked, ["feature"], "value", weights, [0.5]).select(
        "feature", F.col("weight").alias("fit"), F.col("value").alias("median")
    )
    missing = counts.where(F.col("value").isNull()).drop("value").unpivot(
        ["feature"], list(weights.values()), "fit", "n_missing"
    ).withColumn("fit", F.expr("substring(fit, 3)"))
    frame = df.sparkSession.createDataFrame(
        [(f, k) for f in features for k in fits], "feature string, fit string"
    )
    centre = materialised(
        frame.join(med, ["feature", "fit"], "left")
        .join(missing, ["feature", "fit"], "left")
        .select(
            "feature",
            "fit",
            F.coalesce("median", F.lit(0.0)).alias("median"),
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        )
    )
    known = ranked.select("feature", "value", *weights.values())
    bounds = _bounds_after_filling(ranked, centre, weights, quantiles)
    imputed = centre.where(F.col("n_missing") > 0).select(
        "feature",
        F.col("median").alias("value"),
        *[F.when(F.col("fit") == k, F.col("n_missing")).otherwise(0).alias(w) for k, w in weights.items()],
    )
    filled = known.unionByName(imputed)
    limits = centre.join(bounds, ["feature", "fit"])
    long = filled.unpivot(["feature", "value"], list(weights.values()), "fit", "n").withColumn(
        "fit", F.expr("substring(fit, 3)")
    )
    # features x fits rows: bounded by parameters
    near = clip(F.col("value"), F.col("lower"), F.col("upper")) - F.col("median")
    moments = (
        long.where(F.col("n") > 0)
        .join(F.broadcast(limits), ["feature", "fit"])
        .groupBy("feature", "fit", "median", "lower", "upper", "n_missing")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * near).alias("_s"),
            F.sum(F.col("n") * near * near).alias("_ss"),
        )
    )
    shift = ratio(F.col("_s"), F.col("n"))
    variance = F.greatest(ratio(F.col("_ss"), F.col("n")) - shift * shift, F.lit(0.0))
    std = F.sqrt(variance)
    return moments.select(
        "fit",
        "feature",
        "median",
        "lower",
        "upper",
        (F.col("median") + shift).alias("mean"),
        F.when(std > 0, std).otherwise(1.0).alias("scale"),
        "n",
        "n_missing",
    )


def apply_statistics(
    df: DataFrame,
    stats: DataFrame,
    features: Sequence[str],
    indicators: Sequence[str] = (),
    nominals: Sequence[str] = (),
    fit: str = "fit",
    keep: Sequence[str] = (),
    scale: bool = True,
) -> DataFrame:
    """Fill, clip, standardise; then missing indicators; then nominal codes.

    ``df`` carries the name of the fit to use in column ``fit``.
    """
    payload = "named_struct('median', median, 'lower', lower, 'upper', upper, 'mean', mean, 'scale', scale)"
    per_fit = stats.groupBy("fit").agg(
        *[F.expr(f"first(CASE WHEN feature = '{c}' THEN {payload} END, true)").alias(f"_{c}") for c in features]
    )
    # one row per fit: bounded by parameters
    joined = df.join(F.broadcast(per_fit.withColumnRenamed("fit", fit)), fit)

    def prepared(c: str) -> Column:
        filled = f"coalesce(CAST(`{c}` AS DOUBLE), `_{c}`.median)"
        x = f"least(greatest({filled}, `_{c}`.lower), `_{c}`.upper)"
        return F.expr(f"({x} - `_{c}`.mean) / `_{c}`.scale" if scale else x).alias(c)

    return joined.select(
        *keep,
        *[prepared(c) for c in features],
        *[F.expr(f"int(`{c}` IS NULL)").alias(f"{c}_missing") for c in indicators],
        *nominals,
    )


def winsor_bounds(df: DataFrame, features: Sequence[str], quantiles=(0.01, 0.99)) -> DataFrame:
    """Frame-level bounds without imputation: feature, lower, upper."""
    lo, hi = quantiles
    counts = value_counts(df, features, {"all": F.lit(True)}).where(F.col("value").isNotNull())
    q = weighted_quantiles(counts, ["feature"], "value", {"all": "n_all"}, [lo, hi])
    return q.groupBy("feature").agg(
        F.max(F.when(F.col("q") == lo, F.col("value"))).alias("lower"),
        F.max(F.when(F.col("q") == hi, F.col("value"))).alias("upper"),
    )


def apply_winsor(df: DataFrame, bounds: DataFrame, features: Sequence[str]) -> DataFrame:
    """Clip with fitted bounds; features without bounds stay as they are."""
    one = bounds.agg(
        F.struct(
            *[
                F.first(F.when(F.col("feature") == c, F.struct("lower", "upper")), ignorenulls=True).alias(c)
                for c in features
            ]
        )
    )
    b = F.col("_bounds")
    clipped = {
        c: F.when(b[c].isNull(), F.col(c).cast("double")).otherwise(
            clip(F.col(c).cast("double"), b[c]["lower"], b[c]["upper"])
        )
        for c in features
    }
    return df.withColumn("_bounds", one.scalar()).withColumns(clipped).drop("_bounds")


def missing_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Which features need an indicator: feature, has_missing."""
    flags = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in features])
    return flags.unpivot([], list(features), "feature", "has_missing")


def baseline_row(df: DataFrame, features: Sequence[str], nominals: Sequence[str]) -> DataFrame:
    """Neutral values: median per feature, mode (smallest value on ties) per nominal."""
    counts = value_counts(df, features, {"all": F.lit(True)}).where(F.col("value").isNotNull())
    med = weighted_quantiles(counts, ["feature"], "value", {"all": "n_all"}, [0.5]).select("feature", "value")
    all_features = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    med = all_features.join(med, "feature", "left").select("feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    if not nominals:
        return med
    long = df.select(*[F.col(c).cast("double").alias(c) for c in nominals]).unpivot(
        [], list(nominals), "feature", "value"
    )
    mode = (
        long.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("feature")
        .agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m"))
        .select("feature", (-F.col("m.v")).alias("value"))
    )
    return med.unionByName(mode)


def vocabulary(train: DataFrame, nominals: Sequence[str]) -> DataFrame:
    """Integer codes of training levels by string order: feature, level, code, n_levels.

    Codes come from range partitions, so a column with very many levels is fine.
    """
    from scorelab.operators.ordering import numbered

    long = train.select(*[F.col(c).cast("string").alias(c) for c in nominals]).unpivot(
        [], list(nominals), "feature", "level"
    )
    levels = long.where(F.col("level").isNotNull()).distinct()
    coded = numbered(levels, ["feature"], ["level"], "_c")
    return coded.select(
        "feature", "level", (F.col("_c") - 1).alias("code"), F.col("_c_total").alias("n_levels")
    )


def encode(df: DataFrame, words: DataFrame, nominals: Sequence[str]) -> DataFrame:
    """Replace nominal text by its code; unseen and missing become n_levels."""
    out = df
    sizes = words.agg(
        F.struct(*[F.max(F.when(F.col("feature") == c, F.col("n_levels"))).alias(c) for c in nominals])
    )
    for c in nominals:
        # a short vocabulary goes to the rows, so a level that very many rows share is no one's task
        part = checked_broadcast(words.where(F.col("feature") == c).select(
            F.col("level").alias(f"_l_{c}"), F.col("code").alias(f"_c_{c}")
        ))
        out = out.join(part, F.col(c).cast("string") == F.col(f"_l_{c}"), "left").drop(f"_l_{c}")
    out = out.withColumn("_sizes", sizes.scalar())
    codes = {
        c: F.coalesce(F.col(f"_c_{c}"), F.col("_sizes")[c], F.lit(0)).cast("int") for c in nominals
    }
    return out.withColumns(codes).drop("_sizes", *[f"_c_{c}" for c in nominals])

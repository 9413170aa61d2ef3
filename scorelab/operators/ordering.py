"""Ordered operators that never put one key's rows into one task.

A window over a whole key would do the same on small data, but one key may hold
a third of all rows. Rows are therefore range-partitioned on (keys, order), each
partition becomes a chunk, chunk totals give offsets, and the window runs inside
a chunk. The chunk number is written out once (checkpoint), so a lost executor
or a second use of the table cannot change the cut points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.numeric import lerp
from scorelab.session import materialised

CHUNK = "_chunk"


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stamp every row with the number of its range partition on (keys, order)."""
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return materialised(ranged.withColumn(CHUNK, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows of the key) and ``<name>_total``.

    (keys, order) must be unique: aggregate ties first, or end ``order`` with a
    row id.
    """
    keys, names = list(keys), list(sums)
    chunks = in_chunks(df, keys, order)
    per_chunk = chunks.groupBy(*keys, CHUNK).agg(
        *[F.sum(sums[n]).alias(f"_{n}_chunk") for n in names]
    )
    # at most (range partitions + keys) rows
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_chunk.select(
        *keys,
        CHUNK,
        *[F.coalesce(F.sum(f"_{n}_chunk").over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in names],
        *[F.sum(f"_{n}_chunk").over(whole).alias(f"{n}_total") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A sort-merge join on (keys, chunk), whatever the size estimates say: it spreads
    # a hot key over its chunks and leaves the partitioning that the window needs.
    out = chunks.hint("merge").join(offsets, [*keys, CHUNK])
    before = {
        f"{n}_before": F.coalesce(F.sum(sums[n]).over(inside), F.lit(0)) + F.col(f"_{n}_offset")
        for n in names
    }
    return out.withColumns(before).drop(CHUNK, *[f"_{n}_offset" for n in names])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """Row number from 1 in each key (``name``) and the key's row count (``<name>_total``)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(one, keys, order, {name: "_one"})
    return out.withColumn(name, F.col(f"{name}_before") + 1).drop("_one", f"{name}_before")


def _step(probs: Sequence[float]) -> float | None:
    """The distance of a long evenly spaced list of probabilities."""
    step = (probs[-1] - probs[0]) / (len(probs) - 1) if len(probs) >= 8 else 0.0
    even = step and all(abs(probs[0] + i * step - q) <= step * 1e-6 for i, q in enumerate(probs))
    return step if even else None


def _may_serve(label: str, column: str, probs: Sequence[float]) -> str:
    """Plain SQL that is true for every row that some probability touches, and for few others."""
    n, before = f"`{label}_total`", f"`{label}_before`"
    upto, step = f"({before} + `{column}`)", _step(probs)
    if step:
        unit, shift = f"(greatest({n} - 1, 1) * {step!r}D)", f"{probs[0] / step!r}D"
        near = f"ceil(({before} - 3) / {unit} - {shift}) <= floor(({upto} + 2) / {unit} - {shift})"
    else:
        near = " OR ".join(f"(({n} - 1) * {float(q)!r}D >= {before} - 3 AND ({n} - 1) * {float(q)!r}D <= {upto} + 2)" for q in probs)
    return f"(`{column}` > 0 AND ({n} <= 1 OR {near}))"


def _near(probs: Sequence[float], n: str, before: str, upto: str) -> str:
    """SQL for a slice of ``probs`` that contains every probability this row can serve.

    Only long evenly spaced lists need it; the exact test follows either way.
    """
    wanted = "array(" + ", ".join(f"{float(q)!r}D" for q in probs) + ")"
    step = _step(probs)
    if not step:
        return wanted
    unit, shift = f"(greatest({n} - 1, 1) * {step!r}D)", f"{probs[0] / step!r}D"
    first = f"greatest(floor(({before} - 1) / {unit} - {shift}) - 1, 0)"
    last = f"least(ceil(({upto}) / {unit} - {shift}) + 1, {len(probs) - 1})"
    span = f"slice({wanted}, int({first} + 1), int(greatest({last} - {first} + 1, 0)))"
    return f"CASE WHEN {n} > 1 THEN {span} ELSE {wanted} END"


def _quantile_hits(label: str, column: str, probs: Sequence[float]) -> str:
    """SQL for the probabilities whose two order statistics touch this row's run of equal values.

    One expression text instead of many column calls: it is repeated per weight.
    """
    n, before = f"`{label}_total`", f"`{label}_before`"
    upto = f"{before} + `{column}`"
    low = f"floor(({n} - 1) * q)"
    high = f"least({low} + 1, {n} - 1)"

    def holds(position: str) -> str:
        return f"({position} >= {before} AND {position} < {upto})"

    hits = f"filter({_near(probs, n, before, upto)}, q -> {holds(low)} OR {holds(high)})"
    entry = (
        f"named_struct('weight', '{label}', 'q', q, 't', ({n} - 1) * q - {low}, "
        f"'is_low', {holds(low)}, 'is_high', {holds(high)})"
    )
    found = f"transform({hits}, q -> {entry})"
    return f"CASE WHEN `{column}` > 0 THEN {found} ELSE slice({found}, 1, 0) END"


def weighted_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, str],
    probs: Sequence[float],
) -> DataFrame:
    """Exact quantiles (linear interpolation) of a table of value counts.

    ``weights`` maps a label to a LONG count column; all labels share one sort,
    so e.g. every fold's training rows are served by the same pass. Result:
    keys, weight, q, value.
    """
    return quantiles_of_ranked(prefix_sums(counts, list(keys), [value], weights), keys, value, weights, probs)


def quantiles_of_ranked(ranked: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, str], probs: Sequence[float]) -> DataFrame:
    """``weighted_quantiles`` of value counts that have been through ``prefix_sums`` already."""
    keys = list(keys)
    pieces = ", ".join(_quantile_hits(label, column, probs) for label, column in weights.items())
    hit = ranked.where(" OR ".join(_may_serve(label, column, probs) for label, column in weights.items())).select(
        *keys, F.col(value).alias("_v"), F.expr(f"explode(concat({pieces}))").alias("h")
    ).select(*keys, "_v", "h.*")
    ends = hit.groupBy(*keys, "weight", "q").agg(
        F.max(F.when(F.col("is_low"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("is_high"), F.col("_v"))).alias("_hi"),
        F.max("t").alias("_t"),
    )
    return ends.select(
        *keys, "weight", "q", lerp(F.col("_lo"), F.col("_hi"), F.col("_t")).alias("value")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Exact quantiles of ``value`` in each key; NULLs are ignored. keys, q, value."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return weighted_quantiles(counts, keys, "_value", {"all": "_n"}, probs).drop("weight")


#: A value with more rows than this, and than one ten-thousandth of all, is met by a broadcast of such values.
HOT_ROWS = 100_000


def join_on_value(df: DataFrame, table: DataFrame, keys: Sequence[str], count: str, hot: int = HOT_ROWS) -> DataFrame:
    """Join rows with a table of their distinct ``keys`` (a score or other value among them); null keys meet too.

    ``count`` in ``table`` is the number of rows of a key. A value that very many rows share would be one
    task; keys of more than ``hot`` rows and of at least one in 10,000 of all rows - so never more than 10,000
    keys - are broadcast to the rows instead, and only the others are shuffled.
    """
    keys = list(keys)
    known = materialised(table.withColumnRenamed(count, "_rows"))
    total = known.agg(F.sum("_rows")).first()[0] or 0
    least = max(hot, total // 10_000)
    many = known.where(F.col("_rows") > least)

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        on = [left[k].eqNullSafe(other[f"_of_{k}"]) for k in keys]
        return left.join(other, on, how).drop(*[f"_of_{k}" for k in keys], "_rows")

    if not many.limit(1).count():
        return met(df, known, "inner")
    rare = met(df, F.broadcast(many.select(*keys, "_rows")), "left_anti")
    return met(df, F.broadcast(many), "inner").unionByName(met(rare, known.where(F.col("_rows") <= least), "inner"))


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", descending: bool = False
) -> DataFrame:
    """Ranks with ties averaged, for keys of any size.

    Ranks are found on distinct values and joined back on (keys, value).
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).alias("_rv")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(counts, keys, ["_rv"], {"c": "_n"})
    up = F.col("c_before") + (F.col("_n") + 1) / F.lit(2.0)
    rank = F.col("c_total") + 1 - up if descending else up
    ranks = ranked.select(*keys, F.col("_rv").alias(value), rank.alias(name), F.col("_n").alias("_ties"))
    return join_on_value(df, ranks, [*keys, value], "_ties")

"""Bootstrap intervals from row weights that depend on the row alone.

``poisson``: each row is a stream of 32-bit numbers, named by one hash of its key;
number i of the stream draws the Poisson(1) weight of replicate i. All models
and both passes share the streams (paired), and no row order or partition
matters. ``multinomial``: exactly n draws with replacement. Rows stand in range
chunks; n splits down the binary tree of chunks by conditional binomials, each
seeded by its node, so every chunk finds its number of draws by itself, and goes
on splitting down to blocks of rows. A row's weights are one byte a replicate.

Rows are never multiplied by replicates. A model's scores are sorted once, in
range chunks; a task streams its chunk, draws the weights of a block of rows for
all replicates as one matrix and keeps sums per replicate. What leaves a task is
one row of arrays per chunk; sums over chunks run per replicate, as numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.functions.hashing import counter_block, poisson_block, stream_key
from scorelab.functions.numeric import ratio
from scorelab.operators.compare import model_pairs
from scorelab.operators.fairness import EVERYONE, MISSING, RATES
from scorelab.operators.metrics import usable_score
from scorelab.operators.ordering import CHUNK, in_chunks
from scorelab.session import checked_broadcast, materialised

METRICS = ["AUROC", "AUPRC", "Brier", "F1", "MCC"]
# Fixed value: the report's wording
SCOPE = "conditional_on_fitted_models_and_selected_thresholds"
#: Replicates drawn at once, and rows drawn at once: a block of weights is rows x replicates.
BATCH, BLOCK = 2000, 1024


def _batches(reps: int, batch: int) -> Iterator[tuple[int, int]]:
    for start in range(0, reps, batch):
        yield start, min(start + batch, reps) - 1


def poisson_weights(first: np.ndarray, second: np.ndarray, start: int, end: int) -> np.ndarray:
    """Weights of replicates ``start`` to ``end`` (inclusive) of the rows whose streams have these keys."""
    return poisson_block(counter_block(first, second, start, end))


def _streams(seed: int | str, keys: Sequence[str]) -> list:
    first, second = stream_key(seed, *keys)
    return [first.alias("_k0"), second.alias("_k1")]


def draws_below(seed: int, sizes: np.ndarray, wanted: int, m: np.ndarray, name: Sequence[int]) -> np.ndarray:
    """Draws on leaf ``wanted`` when ``m`` draws (one number a replicate) split down the binary tree over leaves of
    ``sizes`` rows. A node's split is seeded by its place, so all leaves below agree on it."""
    a, b = 0, len(sizes)
    while b - a > 1:
        middle = (a + b) // 2
        whole, left = int(sizes[a:b].sum()), int(sizes[a:middle].sum())
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *name, a, b])))
        first = rng.binomial(m, left / whole)
        a, b, m = (a, middle, first) if wanted < middle else (middle, b, m - first)
    return m


def with_multinomial_weights(rows: DataFrame, row_key: Sequence[str], first: int, last: int, seed: int) -> DataFrame:
    """The distinct ``row_key`` of ``rows`` with ``_w``: a byte a replicate, in all exactly n draws per replicate."""
    keys = list(row_key)
    ids = in_chunks(rows.select(*keys).distinct(), [], keys)
    # one number per range partition
    sizes = {r[CHUNK]: r["n"] for r in ids.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")).collect()}
    order, reps = sorted(sizes), last - first + 1
    counts = np.array([sizes[c] for c in order], np.int64)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, at = None, 0
        for frame in frames:
            codes = frame[CHUNK].to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and codes[a] != chunk:
                    chunk, at = int(codes[a]), 0
                    n = sizes[chunk]
                    mine = draws_below(seed, counts, order.index(chunk), np.full(reps, counts.sum()), [first])
                    blocks = np.diff(np.append(np.arange(0, n, BLOCK), n))
                while a < b:
                    if at % BLOCK == 0:
                        size = int(blocks[at // BLOCK])
                        m = draws_below(seed, blocks, at // BLOCK, mine, [first, chunk])
                        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, first, chunk, at, 0, 0])))
                        picks = rng.integers(0, size, int(m.sum())) * reps + np.repeat(np.arange(reps), m)
                        block = np.bincount(picks, minlength=size * reps).reshape(size, reps)
                    here = block[at % BLOCK :][: b - a].astype(np.uint8)
                    part = frame.iloc[a : a + len(here)][keys].copy()
                    part["_w"] = [w.tobytes() for w in here]
                    yield part
                    a, at = a + len(here), at + len(here)

    # sorted inside its chunk, a row stands in the same block in every run
    ordered = ids.repartition(CHUNK).sortWithinPartitions(CHUNK, *keys)
    kept = ", ".join(f"`{k}` {t}" for k, t in ids.select(*keys).dtypes)
    return ordered.mapInPandas(draw, f"{kept}, _w binary")


def _segments(frame: pd.DataFrame, by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Blocks of rows that agree on ``by``; the frame is sorted by it."""
    codes = frame.groupby(list(by), sort=False, dropna=False).ngroup().to_numpy()
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(frame)]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, BLOCK):
            yield frame.iloc[at : min(at + BLOCK, b)]


#: Keys whose totals a task holds before it hands them on.
HELD = 256


def _chunk_totals(draw: Callable, by: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame([[*k, v[0], v[1]] for k, v in held.items()], columns=[*by, "pos", "neg"])
            held.clear()
            return made

        for frame in frames:
            for part in _segments(frame.sort_values(by, kind="stable"), by):
                w, y = draw(part), part["y"].to_numpy(float)
                pos, every = y @ w, w.sum(axis=0)
                at = held.setdefault(tuple(part.iloc[0][by]), [0.0, 0.0])
                at[0], at[1] = at[0] + pos, at[1] + every - pos
                if len(held) == HELD:
                    yield out()
        if held:
            yield out()

    return run


class _Sweep:
    """Sums over one chunk's rows in score order, for all replicates; ``before`` and ``total`` are counts per replicate."""

    def __init__(self, row: pd.Series, by: list[str]):
        self.key = tuple(row[by])
        self.pos, self.neg, self.all_pos, self.all_neg = (np.array(row[c], float) for c in ("_pos", "_neg", "_P", "_N"))
        self.won, self.precision, self.square, self.tp, self.fp = (np.zeros(len(self.pos)) for _ in range(5))
        self.tie, self.tie_pos, self.tie_neg = None, 0.0, 0.0

    def close(self) -> None:
        """Count the scores equal to ``tie``."""
        self.won += self.tie_pos * (self.neg + 0.5 * self.tie_neg)
        tp, fp = self.all_pos - self.pos, self.all_neg - self.neg
        self.precision += np.divide(self.tie_pos * tp, tp + fp, out=np.zeros_like(tp), where=(tp + fp > 0))
        self.pos, self.neg = self.pos + self.tie_pos, self.neg + self.tie_neg
        self.tie = None

    def add(self, part: pd.DataFrame, w: np.ndarray) -> None:
        p, y = part["p"].to_numpy(float), part["y"].to_numpy(float)
        over = p >= part["threshold"].to_numpy(float)
        self.square += ((y - p) ** 2) @ w
        self.tp += (over * y) @ w
        self.fp += (over * (1 - y)) @ w
        starts = np.append(0, np.flatnonzero(p[1:] != p[:-1]) + 1)
        pos, every = np.add.reduceat(w * y[:, None], starts), np.add.reduceat(w, starts)
        for s, a, b in zip(starts, pos, every - pos):
            if self.tie is not None and self.tie != p[s]:
                self.close()
            if self.tie is None:
                self.tie, self.tie_pos, self.tie_neg = p[s], a, b
            else:
                self.tie_pos, self.tie_neg = self.tie_pos + a, self.tie_neg + b

    def row(self) -> list:
        if self.tie is not None:
            self.close()
        return [*self.key, self.won, self.precision, self.square, self.tp, self.fp]


def _chunk_sums(draw: Callable, by: list[str]):
    names = [*by, "won", "precision", "square", "tp", "fp"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Sweep | None = None
        for frame in frames:
            for part in _segments(frame, by):
                if part["_row"].iloc[0] == 0:  # the head of the next chunk
                    if now is not None:
                        yield pd.DataFrame([now.row()], columns=names)
                    now, part = _Sweep(part.iloc[0], by), part.iloc[1:]
                if len(part):
                    now.add(part, draw(part))
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names)

    return run


def _per_replicate(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sums of arrays over rows, as one row per ``by`` and replicate (``_i`` from 0): partial sums before any shuffle."""
    each = rows.select(*by, F.posexplode(F.arrays_zip(*names)).alias("_i", "_v")).select(*by, "_i", "_v.*")
    return each.groupBy(*by, "_i").agg(*[F.sum(n).alias(n) for n in names])


def _swept(
    rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], first: int, draw: Callable, weights: list[str], weighed: Callable = lambda chunks: chunks
) -> DataFrame:
    """Metrics per key, model and replicate; ``draw`` gives a block's weights (rows x replicates) from its ``weights`` columns.

    ``weighed`` adds these columns to rows that know their chunk, so wide ones move once, to the sweep.
    """
    group = [*keys, "model"]
    by = [*group, CHUNK]
    on = [k for k in group if k in thresholds.columns]
    cuts = checked_broadcast(thresholds.select(*on, "threshold"))
    slim = rows.withColumn("p", usable_score(F.col("p").cast("double"))).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in group]))
    slim = slim.join(cuts, on) if on else slim.withColumn("threshold", cuts.select("threshold").scalar())
    # equal scores share a chunk
    chunks = weighed(in_chunks(slim, group, ["p"])).select(*by, *weights, "y", "p", "threshold")
    kept = ", ".join(f"`{k}` {t}" for k, t in chunks.select(*by).dtypes)
    totals = chunks.select(*by, *weights, "y").mapInPandas(_chunk_totals(draw, by), f"{kept}, pos array<double>, neg array<double>")
    per_chunk = materialised(_per_replicate(totals, by, ["pos", "neg"]))
    before = Window.partitionBy(*group, "_i").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group, "_i")
    # one row per chunk and replicate; a chunk's arrays are as long as there are replicates
    sums_before = {f"_{n}": F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in ("pos", "neg")}
    placed = per_chunk.withColumns({**sums_before, "_P": F.sum("pos").over(whole), "_N": F.sum("neg").over(whole)})
    four = ["_pos", "_neg", "_P", "_N"]
    lists = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", *four))).alias("_l"))
    # a chunk's arrays stand in one row at its head, not beside each of its rows
    heads = lists.select(*by, F.lit(0).alias("_row"), *[F.col("_l")[n].alias(n) for n in four])
    both = chunks.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition(*by).sortWithinPartitions(*by, "_row", "p")
    names = ["won", "precision", "square", "tp", "fp"]
    sums = ordered.mapInPandas(_chunk_sums(draw, by), kept + "".join(f", {c} array<double>" for c in names))
    ends = per_chunk.groupBy(*group, "_i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    each = _per_replicate(sums, group, names).join(ends, [*group, "_i"]).withColumn("rep", F.col("_i") + first)
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    fn, tn = pos - tp, neg - fp
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = each.where((pos > 0) & (neg > 0)).select(
        *group, "rep",
        ratio(F.col("won"), pos * neg).alias("AUROC"), ratio(F.col("precision"), pos).alias("AUPRC"),
        ratio(F.col("square"), pos + neg).alias("Brier"),
        F.coalesce(ratio(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("F1"),
        F.coalesce(ratio(tp * tn - fp * fn, spread), F.lit(0.0)).alias("MCC"),
    )
    return materialised(out)


def _poisson(scores, thresholds, keys, first, last, seed) -> DataFrame:
    rows = scores.select("*", *_streams(seed, [*keys, "row_id"]))

    def draw(part: pd.DataFrame) -> np.ndarray:
        return poisson_weights(part["_k0"].to_numpy(), part["_k1"].to_numpy(), first, last).astype(np.float64)

    return _swept(rows, thresholds, keys, first, draw, ["_k0", "_k1"])


def _packed(w: np.ndarray) -> list[bytes]:
    """Two weights a byte; rows with one above 15 keep a byte a weight."""
    even = np.pad(w, ((0, 0), (0, w.shape[1] % 2)))
    small = even[:, ::2] | even[:, 1::2] << 4
    return [s.tobytes() if most < 16 else row.tobytes() for s, row, most in zip(small, w, w.max(axis=1))]


def _unpacked(rows: Sequence[bytes], reps: int) -> np.ndarray:
    out = np.empty((len(rows), reps), np.uint8)
    for i, row in enumerate(rows):
        w = np.frombuffer(row, np.uint8)
        if len(w) == reps and reps > 1:
            out[i] = w
        else:
            out[i, ::2], out[i, 1::2] = (w & 15), (w >> 4)[: reps // 2]
    return out


def _multinomial(scores, thresholds, keys, first, last, seed) -> DataFrame:
    row_key, reps = [*keys, "row_id"], last - first + 1

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = np.frombuffer(b"".join(frame["_w"]), np.uint8).reshape(len(frame), reps)
            yield frame.assign(_w=_packed(w))

    drawn = with_multinomial_weights(scores, row_key, first, last, seed)
    weights = materialised(drawn.mapInPandas(pack, drawn.schema)) if reps > 1 else materialised(drawn)

    def draw(part: pd.DataFrame) -> np.ndarray:
        rows = part["_w"].tolist()
        w = _unpacked(rows, reps) if reps > 1 else np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 1)
        return w.astype(np.float64)

    return _swept(scores, thresholds, keys, first, draw, ["_w"], lambda chunks: chunks.join(weights, row_key))


def draw_totals(weights: DataFrame) -> DataFrame:
    """Draws per replicate over all rows of ``with_multinomial_weights``: rep, draws, rows_in_all (rows that carry a weight for it)."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                rows = frame["_w"].iloc[at : at + BLOCK].tolist()
                part = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).sum(axis=0, dtype=np.int64)
                total, n = part if total is None else total + part, n + len(rows)
        if n:
            yield pd.DataFrame({"draws": [total], "rows_in_all": [np.full(len(total), n)]})

    sums = weights.select("_w").mapInPandas(add, "draws array<long>, rows_in_all array<long>")
    return _per_replicate(sums, [], ["draws", "rows_in_all"]).withColumnRenamed("_i", "rep")


def replicate_metrics(
    scores: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str],
    reps: int = 2000,
    seed: int = 42,
    batch: int | None = None,
    mode: str = "poisson",
) -> DataFrame:
    """Metrics of every (key, model, replicate); replicates with one class are left out.

    ``poisson`` draws a weight for each row, ``multinomial`` exactly n rows; ``batch`` replicates are held at once.
    """
    keys = list(keys)
    modes = {"poisson": _poisson, "multinomial": _multinomial}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    parts = [modes[mode](scores, thresholds, keys, a, b, seed) for a, b in _batches(reps, batch or BATCH)]
    return reduce(DataFrame.unionByName, parts).unpivot([*keys, "model", "rep"], METRICS, "metric", "value")


def _interval(value: str) -> list:
    # one value per replicate: a group is as large as ``reps``
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias("ci_low"), q[1].alias("ci_high"), F.count(F.lit(1)).alias("bootstrap_reps")]


def metric_intervals(replicates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over replicates and the 95 % percentile interval per model and metric."""
    return (
        replicates.groupBy(*keys, "model", "metric")
        .agg(F.avg("value").alias("estimate"), *_interval("value"))
        .withColumn("inference_scope", F.lit(SCOPE))
    )


def paired_differences(replicates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals of model_a - model_b over the same replicates."""
    pairs = model_pairs(replicates, [*keys, "metric", "rep"], ["value"])
    diff = pairs.withColumn("d", F.col("value_a") - F.col("value_b"))
    return (
        diff.groupBy(*keys, "model_a", "model_b", "metric")
        .agg(F.avg("d").alias("difference_mean"), *_interval("d"))
        .withColumn("inference_scope", F.lit(SCOPE))
    )


def policy_differences(
    rows: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    reps: int = 2000,
    seed: int = 42,
    batch: int | None = None,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
) -> DataFrame:
    """Candidate minus reference decisions: accuracy, utility and group gaps with intervals.

    ``rows`` has row_id, y, reference, candidate (boolean) and the group columns;
    a missing group is its own level.
    """
    keys = list(keys)
    flags = ["n", "np", "tp_reference", "tp_candidate", "fp_reference", "fp_candidate"]
    by = [*keys, "group_column", "level"]
    slim = rows.select(*keys, *_streams(seed, [*keys, "row_id"]), "y", "reference", "candidate", *groups)
    kept = ", ".join(f"`{k}` {t}" for k, t in slim.select(*keys).dtypes) + ", " * bool(keys) + "group_column string, level string"
    parts = []
    for first, last in _batches(reps, batch or BATCH):

        def sums(frames: Iterator[pd.DataFrame], first=first, last=last) -> Iterator[pd.DataFrame]:
            for frame in frames:
                held: dict[tuple, np.ndarray] = {}
                for at in range(0, len(frame), BLOCK):
                    part = frame.iloc[at : at + BLOCK]
                    w = poisson_weights(part["_k0"].to_numpy(), part["_k1"].to_numpy(), first, last).astype(np.float64)
                    y, ref, cand = (part[c].to_numpy(float) for c in ("y", "reference", "candidate"))
                    each = np.column_stack([np.ones(len(part)), y, ref * y, cand * y, ref * (1 - y), cand * (1 - y)])
                    for g in [*groups, None]:
                        level = part[g].map(lambda v: MISSING if pd.isna(v) else str(v)) if g else pd.Series(EVERYONE, part.index)
                        own = part[keys].assign(_g=g or EVERYONE, _l=level.to_numpy())
                        for key, places in own.groupby([*keys, "_g", "_l"], sort=False, dropna=False).indices.items():
                            held[key] = held.get(key, 0.0) + each[places].T @ w[places]
                out = [
                    pd.DataFrame({**dict(zip(by, key)), "rep": np.arange(first, last + 1), **dict(zip(flags, m))})
                    for key, m in held.items()
                ]
                if out:
                    yield pd.concat(out)

        partial = slim.mapInPandas(sums, f"{kept}, rep int" + "".join(f", {f} double" for f in flags))
        parts.append(materialised(partial.groupBy(*by, "rep").agg(*[F.sum(f).alias(f) for f in flags]).where("n > 0")))
    cells = reduce(DataFrame.unionByName, parts)
    by_rep = [*keys, "rep"]
    n, np_ = F.col("n"), F.col("np")
    sides = []
    for s in ("reference", "candidate"):
        tp, fp = F.col(f"tp_{s}"), F.col(f"fp_{s}")
        rated = cells.withColumns(
            {"selection": ratio(tp + fp, n), "tpr": ratio(tp, np_), "fpr": ratio(fp, n - np_)}
        )
        gaps = rated.where(F.col("group_column") != EVERYONE).groupBy(*by_rep, "group_column").agg(
            *[F.when(F.count(x) >= 2, F.max(x) - F.min(x)).alias(x) for x in RATES]
        )
        gap_rows = gaps.unpivot([*by_rep, "group_column"], list(RATES), "rate", "value").select(
            *by_rep, F.concat("group_column", F.lit("_"), "rate", F.lit("_gap")).alias("metric"), "value"
        )
        largest = gap_rows.groupBy(*by_rep).agg(F.max("value").alias("value")).select(
            *by_rep, F.lit("max_group_gap").alias("metric"), "value"
        )
        overall = cells.where(F.col("group_column") == EVERYONE).select(
            *by_rep,
            ratio(tp + (n - np_ - fp), n).alias("accuracy"),
            ratio(tp - cost_fp * fp - cost_fn * (np_ - tp), n).alias("utility"),
        ).unpivot(by_rep, ["accuracy", "utility"], "metric", "value")
        sides.append(
            gap_rows.unionByName(largest).unionByName(overall).where(F.col("value").isNotNull())
            .withColumnRenamed("value", s)
        )
    both = sides[0].join(sides[1], [*by_rep, "metric"])
    diff = both.withColumn("d", F.col("candidate") - F.col("reference"))
    return diff.groupBy(*keys, "metric").agg(F.avg("d").alias("difference"), *_interval("d"))

"""Exact attributions of tree ensembles from a table of leaf paths.

A leaf is reached through intervals of a few features. With a set S of features
known, the tree's value is the sum over leaves of value x the product over the
path's features: 1 or 0 in S (does the row lie in the interval), the share of
training rows that go the leaf's way outside S. The Shapley value of a feature is
then a sum over leaves whose weights depend only on how many features of the path
the row satisfies and on elementary symmetric polynomials of the others' shares, so no
subset is ever listed. Rows meet the leaf table once, in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scorelab.operators import boosting, forest


@dataclass(frozen=True)
class Leaf:
    """``value`` of a leaf, its share of the training rows, and per feature of its path the interval (low, high] and
    the share of rows that the splits on that feature let through."""

    value: float
    share: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    through: tuple[float, ...]


@dataclass(frozen=True)
class Node:
    """A split: values <= ``cut`` go ``left``. A leaf has a feature of -1."""

    feature: int
    cut: float
    left: int
    right: int
    value: float
    cover: float


def leaves(nodes: Sequence[Node]) -> list[Leaf]:
    """The leaf paths of one tree; node 0 is the root. Branches without training rows have share 0."""
    out: list[Leaf] = []
    open_: list[tuple[int, dict]] = [(0, {})]
    while open_:
        at, path = open_.pop()
        n = nodes[at]
        if n.feature < 0:
            names = sorted(path)
            share = 1.0
            for f in names:
                share *= path[f][2]
            out.append(Leaf(n.value, share, tuple(names), *(tuple(path[f][i] for f in names) for i in range(3))))
            continue
        low, high, through = path.get(n.feature, (-np.inf, np.inf, 1.0))
        for child, a, b in ((n.left, low, min(high, n.cut)), (n.right, max(low, n.cut), high)):
            part = nodes[child].cover / n.cover if n.cover else 0.0
            open_.append((child, {**path, n.feature: (a, b, through * part)}))
    return out


def _tree_nodes(model: boosting.Model, t: boosting.Tree, share: float = 1.0) -> list[Node]:
    cuts = [float(model.edges[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
    rows = zip(t.feature.tolist(), cuts, t.left.tolist(), t.right.tolist(), (t.value * share).tolist(), t.cover.tolist())
    return [Node(*r) for r in rows]


def boosted_leaves(model: boosting.Model) -> list[Leaf]:
    """Leaf paths of a boosting model; the sum of values is the margin less the start."""
    return [x for t in model.trees for x in leaves(_tree_nodes(model, t))]


def forest_leaves(model: forest.Forest) -> list[Leaf]:
    """Leaf paths of a forest; the sum of values is the probability of class 1."""
    share = 1.0 / max(1, len(model.trees))
    return [x for t in model.trees for x in leaves(_tree_nodes(model, t, share))]


def _weights(most: int) -> np.ndarray:
    """w[m, s]: weight of a set of s features among m, the feature itself not counted: s! (m - s - 1)! / m!"""
    out = np.zeros((most + 1, most + 1))
    for m in range(1, most + 1):
        for s in range(m):
            out[m, s] = factorial(s) * factorial(m - s - 1) / factorial(m)
    return out


def values(rows: np.ndarray, table: Sequence[Leaf], features: int) -> np.ndarray:
    """Attributions (rows x features) of a block of rows."""
    out = np.zeros((len(rows), features))
    weights = _weights(max((len(x.features) for x in table), default=0))
    for leaf in table:
        m = len(leaf.features)
        if not m or leaf.value == 0.0:
            continue
        x = rows[:, leaf.features]
        inside = (x > np.array(leaf.low)) & (x <= np.array(leaf.high))
        z = np.array(leaf.through)
        for i, f in enumerate(leaf.features):
            # poly[s]: sum over sets of s other satisfied features of the product of shares of all others outside the set
            poly = np.zeros((len(rows), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    grown = poly * z[j]
                    grown[:, 1:] += poly[:, :-1] * inside[:, j : j + 1]
                    poly = grown
            out[:, f] += leaf.value * (inside[:, i] - z[i]) * (poly @ weights[m, :m])
    return out


def expected(table: Sequence[Leaf]) -> float:
    """The ensemble's value with no feature known."""
    return float(sum(x.value * x.share for x in table))


def tree_values(df: DataFrame, table: Sequence[Leaf], names: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Exact attributions: row_id, feature, value. They sum to the ensemble's value less ``expected``.

    ``table`` travels to the tasks; its size is bounded by the model's parameters. Rows need all values.
    """
    names, held = list(names), list(table)

    @F.arrow_udf(ArrayType(DoubleType()))
    def attributed(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(names))
        parts = [values(rows[at : at + 4096], held, len(names)) for at in range(0, len(rows), 4096)]
        flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(len(names), 1)), pa.int32()), pa.array(flat))

    wide = df.select(row_id, attributed(F.array(*[F.col(c).cast("double") for c in names])).alias("_v"))
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("_v").alias("value")))
    return wide.select(row_id, pairs.alias("_e")).select(row_id, F.col("_e")["feature"].alias("feature"), F.col("_e")["value"].alias("value"))


def ensemble_value(df: DataFrame, table: Sequence[Leaf], names: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The ensemble's own value from the leaf table: row_id, p."""
    held, names = list(table), list(names)

    @F.arrow_udf(DoubleType())
    def whole(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(names))
        out = np.zeros(len(rows))
        for leaf in held:
            own = rows[:, leaf.features]
            out += leaf.value * ((own > np.array(leaf.low)) & (own <= np.array(leaf.high))).all(axis=1)
        return pa.array(out)

    return df.select(row_id, whole(F.array(*[F.col(c).cast("double") for c in names])).alias("p"))

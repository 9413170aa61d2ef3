"""Gradient boosting over histograms: many fits grow their trees side by side.

Training rows are binned once per row set and kept in blocks, where rows of equal bins, label, weight
and part are one cell with its number of rows; the bins bound the cells, however many rows there are. In each round every
fit adds one tree, level by level: a job sums gradients, Hessians and rows of
its nodes by (fit, node, feature, bin), so one aggregate a level serves all fits. Only the smaller
child of a split is summed; the larger is its parent less the smaller. Splits
are chosen where the sums meet, and what reaches the driver is one split per node.

A row set of at most ``HELD`` rows, or of few cells, needs no such jobs: its fits are spread over tasks that
hold its blocks and take the same steps there, each by the same functions.

Three ways to grow: ``level`` splits every node that gains, ``leaf`` splits the leaf
that gains most until there are enough leaves, ``symmetric`` splits a whole level by
one cut. Gains are of second order with L1 and L2 penalties.

A fit with a slice of held rows stops when their AUROC has not risen for
``patience`` rounds, and keeps the trees up to its best round; it then leaves the
jobs while the others go on. The blocks are kept once; the margins of all fits
beside them grow by one tree a round and are written to the checkpoint folder every
``CUT`` rounds, and those they replace are deleted.
"""

from __future__ import annotations

import gc
import heapq
import pickle
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scorelab.functions.hashing import counter_block, stream_key
from scorelab.operators.ordering import weighted_quantiles
from scorelab.session import ensure_checkpoint_dir, materialised

#: Bins per feature, rows of a block, rounds between checkpoints, and steps of the probability in which held rows are ranked.
BINS, BLOCK, CUT, RANKS = 64, 65_536, 20, 65_536
#: Rows (or cells) of a set that one task holds, keys of rows that it holds beside cells, and joint bins at most of features that are summed together.
HELD, KEYS, CELLS = 524_288, 8_388_608, 1024
#: Rows that are dealt to blocks at once, and rows of one cell that go to the same block.
DEALT, PIECE = 262_144, 4096
#: Gains closer than this part of the largest are equal; the earlier feature and cut win.
SAME = 1e-9


@dataclass(frozen=True)
class Settings:
    """``depth`` -1: bounded by ``leaves`` only. ``rows``, ``columns``: shares drawn for each tree."""

    growth: str = "level"
    rounds: int = 500
    depth: int = 6
    rate: float = 0.05
    leaves: int = 0
    rows: float = 1.0
    columns: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    patience: int = 30
    from_mean: bool = True


@dataclass(frozen=True)
class Fit:
    """One model: ``rows`` names its row set."""

    name: str
    rows: str
    settings: Settings
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, 0 the root; a feature of -1 is a leaf. Rows with bin <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    def nodes(self, bins: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row; ``known`` are the rows' nodes in an earlier stage of this tree."""
        at = np.zeros(len(bins), np.int32) if known is None else known.copy()
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            now = at[open_]
            low = bins[open_, self.feature[now]] <= self.cut[now]
            at[open_] = np.where(low, self.left[now], self.right[now])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Model:
    """A fitted ensemble: the trees up to the best round."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    history: list[float] = field(default_factory=list)
    rounds: int = 0

    def bins(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.edges)

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        margin = np.full(len(bins), self.start)
        for tree in self.trees:
            margin += tree.scores(bins)
        return margin

    def score(self, *columns: Column) -> Column:
        """The probability of class 1, from the features in order."""
        model = self

        @F.arrow_udf(DoubleType())
        def predicted(values: pa.Array) -> pa.Array:
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            return pa.array(_sigmoid(model.scores(rows)))

        return predicted(F.array(*[c.cast("double") for c in columns]))

    def importances(self) -> list[tuple[str, float]]:
        """Share of the total gain per feature."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        whole = total.sum()
        return list(zip(self.features, (total / whole if whole else total).tolist()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Number of edges below each value, so ``bin <= b`` means ``value <= edges[b]``."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i], side="left")
    return out


# --- choosing splits -----------------------------------------------------------


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def quality(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """T(G)^2 / (H + l2), with T shrinking by ``alpha``; nothing without Hessian."""
    below = h + s.l2
    return np.divide(_shrunk(g, s.alpha) ** 2, below, out=np.zeros_like(below), where=below > 0)


def weight(g: float, h: float, s: Settings) -> float:
    return float(-s.rate * _shrunk(np.float64(g), s.alpha) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def _cut_gains(part: np.ndarray, s: Settings, forced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gain of every cut of one feature (nodes x cuts) and the sums left of it; ``part`` is nodes x bins x 3."""
    left = np.cumsum(part, axis=1)
    total, left = left[:, -1:], left[:, :-1]
    right = total - left
    gain = 0.5 * (quality(left[..., 0], left[..., 1], s) + quality(right[..., 0], right[..., 1], s) - quality(total[..., 0], total[..., 1], s))
    if not forced:
        enough = (np.minimum(left[..., 1], right[..., 1]) >= s.min_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= s.min_rows)
        gain = np.where(enough, gain - s.gamma, -np.inf)
    return gain, left


def best_splits(sums: np.ndarray, sizes: Sequence[int], columns: Sequence[int], s: Settings) -> list[tuple]:
    """Per node: (total, gain, feature, cut, sums left of it); with ``symmetric`` growth all nodes share one cut.

    ``sums`` is nodes x all bins x 3, ``sizes`` the bins of each feature.
    """
    ends = np.cumsum(sizes)
    shared = s.growth == "symmetric"
    total = sums[:, : sizes[0]].sum(axis=1)
    best = [(0.0, -1, -1)] * (1 if shared else len(sums))
    lefts: dict[int, np.ndarray] = {}
    for f in columns:
        if sizes[f] < 2:
            continue
        gain, lefts[f] = _cut_gains(sums[:, ends[f] - sizes[f] : ends[f]], s, shared)
        gain = gain.sum(axis=0, keepdims=True) if shared else gain
        top = gain.max(axis=1)
        at = np.argmax(gain >= (top - SAME * np.abs(top))[:, None], axis=1)
        for node, (g, b) in enumerate(zip(top.tolist(), at.tolist())):
            if g > best[node][0] * (1 + SAME) and g > 1e-12:
                best[node] = (g, f, b)
    out = []
    for node in range(len(sums)):
        gain, f, b = best[0 if shared else node]
        own = lefts[f][node, b] if f >= 0 else np.zeros(3)
        out.append((total[node], gain, f, b, own))
    return out


class Growth:
    """A tree under construction, on the driver: statistics of nodes and the splits known so far."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.total: list[np.ndarray] = [np.zeros(3)]
        self.level, self.found, self.child = [0], {}, {}
        self.fresh = [0]  # nodes whose sums were asked for last

    def learn(self, results: Sequence[tuple]) -> None:
        for node, (total, *split) in zip(self.fresh, results, strict=True):
            self.total[node] = total
            self.found[node] = split

    def _split(self, node: int) -> tuple[int, int]:
        if node not in self.child:
            _, _, _, left = self.found[node]
            self.child[node] = (len(self.total), len(self.total) + 1)
            self.total += [left, self.total[node] - left]
            self.level += [self.level[node] + 1] * 2
        return self.child[node]

    def _may_split(self, node: int) -> bool:
        deep = self.s.depth >= 0 and self.level[node] >= self.s.depth
        return not deep and (self.s.growth == "symmetric" or self.total[node][2] >= 2 * self.s.min_rows)

    def _chosen(self) -> list[int]:
        """The nodes to split, in order. Leaf growth replays the choice of the best leaf with all splits known so far."""
        if self.s.growth != "leaf":
            return [n for n in sorted(self.found) if self.found[n][1] >= 0]
        out, heap = [], [(-self.found[0][0], 0)] if self.found[0][1] >= 0 else []
        while heap and (self.s.leaves <= 0 or len(out) + 1 < self.s.leaves):
            _, node = heapq.heappop(heap)
            out.append(node)
            for c in self._split(node):
                if c in self.found and self.found[c][1] >= 0:
                    heapq.heappush(heap, (-self.found[c][0], c))
        return out

    def wanted(self) -> list[tuple[int, int, int]]:
        """(parent, smaller child, larger child) of the splits whose children's sums are needed next."""
        out = []
        for node in self._chosen():
            a, b = self._split(node)
            if a in self.found or b in self.found or not (self._may_split(a) or self._may_split(b)):
                continue
            out.append((node, a, b) if self.total[a][2] <= self.total[b][2] else (node, b, a))
        self.fresh = [n for _, small, large in out for n in (small, large)]
        return out

    def tree(self, closed: bool = True) -> Tree:
        """The tree as it stands; leaves get their values when it is ``closed``."""
        chosen = {n: self.child[n] for n in (self._chosen() if closed else self.child)}
        n = len(self.total)
        feature, cut, left, right = (np.full(n, -1, np.int32) for _ in range(4))
        gain = np.zeros(n)
        for node, (a, b) in chosen.items():
            gain[node], feature[node], cut[node], _ = self.found[node]
            left[node], right[node] = a, b
        value = np.array([weight(t[0], t[1], self.s) for t in self.total]) if closed else np.zeros(n)
        return Tree(feature, cut, left, right, value, gain, np.array([t[2] for t in self.total]))


# --- the jobs ------------------------------------------------------------------


def _cells(bins: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, list[int]]]:
    """Each row's cell in the joint bins of features with few of them, and which features these are."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=sizes.__getitem__):
        if groups and np.prod([sizes[i] for i in groups[-1]]) * sizes[f] <= CELLS:
            groups[-1].append(f)
        else:
            groups.append([f])
    return [(np.ravel_multi_index(tuple(bins[:, g].T.astype(np.intp)), [sizes[f] for f in g]).astype(np.uint16), g) for g in groups]


def per_cell(block: Mapping, of_rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over the rows of each cell of what ``of_rows`` says of their keys."""
    starts = np.cumsum(block["n"], dtype=np.int64) - block["n"]
    found = np.empty(len(block["k0"]), np.uint32)
    for at in range(0, len(found), DEALT):
        found[at : at + DEALT] = of_rows(block["k0"][at : at + DEALT], block["k1"][at : at + DEALT])
    return np.add.reduceat(found, starts) if len(found) else found


def _gradients(block: dict, margin: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell of a block: how many of its rows the tree uses, gradient and Hessian."""
    use = block.get("n", 1)
    if plan["rows"] < 1.0:
        at, below = plan["draw"], np.uint32(plan["rows"] * 2.0**32)
        use = per_cell(block, lambda k0, k1: counter_block(k0, k1, at, at)[:, 0] < below)
    use = np.where(block["stop"], 0, use)
    p, w = _sigmoid(margin), block["w"] * use
    return use, w * (p - block["y"]), w * p * (1 - p)


def _node_sums(
    block: dict, margin: np.ndarray, plan: dict, sizes: Sequence[int], nodes: np.ndarray | None = None, known: tuple | None = None
) -> np.ndarray:
    """Sums of one block for one fit: wanted nodes x bins x (gradient, Hessian, rows). ``known``: the block's gradients."""
    use, g, h = _gradients(block, margin, plan) if known is None else known
    nodes = plan["tree"].nodes(block["bins"]) if nodes is None else nodes
    many = len(plan["small"])
    slot = np.full(len(plan["tree"].feature), -1, np.int64)
    slot[plan["small"]] = np.arange(many)
    place = np.where(use > 0, slot[nodes], -1)
    rows = np.flatnonzero(place >= 0)
    place, g, h, use = place[rows], g[rows], h[rows], use[rows]
    ends = np.cumsum(sizes)
    out = np.empty((many, ends[-1], 3))
    for cells, features in block["cells"]:
        shape = [sizes[f] for f in features]
        size = int(np.prod(shape))
        at = place * size + cells[rows]
        joint = [x.reshape(many, *shape) for x in (np.bincount(at, g, many * size), np.bincount(at, h, many * size), np.bincount(at, use, many * size))]
        for i, f in enumerate(features):
            others = tuple(1 + j for j in range(len(features)) if j != i)
            for kind, x in enumerate(joint):
                out[:, ends[f] - sizes[f] : ends[f], kind] = x.sum(axis=others)
    return out


def _ranked(block: dict, margin: np.ndarray) -> np.ndarray:
    """Held rows by step of their probability: steps, positives, negatives."""
    steps = np.minimum((_sigmoid(margin[block["stop"]]) * RANKS).astype(np.int64), RANKS - 1)
    known, place = np.unique(steps, return_inverse=True)
    y, n = block["y"][block["stop"]], block["n"][block["stop"]]
    return np.stack([known, np.bincount(place, y * n, len(known)), np.bincount(place, (1 - y) * n, len(known))])


def _rank_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.concatenate([a, b], axis=1)
    known, place = np.unique(both[0], return_inverse=True)
    return np.stack([known, np.bincount(place, both[1], len(known)), np.bincount(place, both[2], len(known))])


def ranked_auroc(ranks: np.ndarray) -> float | None:
    """Ties count half; None with one class."""
    pos, neg = ranks[1], ranks[2]
    below = np.cumsum(neg) - neg
    both = pos.sum() * neg.sum()
    return float((pos * (below + 0.5 * neg)).sum() / both) if both else None


def _plan(growth: Growth, wanted: Sequence[tuple[int, int, int]], fit: Fit, turn: int) -> dict:
    """What a level's sums need: the tree so far, the nodes to sum and the rows drawn for this tree."""
    draw = 1_000_003 * (fit.seed % 1000) + turn
    return {"tree": growth.tree(closed=False), "small": [w[1] for w in wanted], "rows": fit.settings.rows, "draw": draw}


def _with_siblings(wanted: Sequence[tuple[int, int, int]], own: np.ndarray, before: dict, keep: bool) -> dict:
    """Sums by node: the smaller children's as they are, the larger ones' by difference from their parents."""
    out = dict(before) if keep else {}
    for (parent, small, large), part in zip(wanted, own):
        out[small], out[large] = part, before[parent] - part
    return out


def _tree_of_block(block: dict, margin: np.ndarray, fit: Fit, turn: int, sizes: Sequence[int]) -> Tree:
    growth, columns = Growth(fit.settings), _columns(fit, turn, len(sizes))
    wanted, sums, nodes, known = [(-1, 0, -1)], None, None, None
    while wanted:
        plan = _plan(growth, wanted, fit, turn)
        known = _gradients(block, margin, plan) if known is None else known
        nodes = plan["tree"].nodes(block["bins"], nodes)
        own = _node_sums(block, margin, plan, sizes, nodes, known)
        sums = {0: own[0]} if sums is None else _with_siblings(wanted, own, sums, fit.settings.growth == "leaf")
        growth.learn(best_splits(np.stack([sums[n] for n in growth.fresh]), sizes, columns, fit.settings))
        wanted = growth.wanted()
    return growth.tree()


def _fit_of_block(block: dict, fit: Fit, start: float, sizes: Sequence[int]) -> tuple[list[Tree], list[float]]:
    """All rounds of one fit on a set of one block: trees and the AUROC after each."""
    margin, trees, history = np.full(len(block["y"]), start), [], []
    for turn in range(fit.settings.rounds):
        trees.append(_tree_of_block(block, margin, fit, turn, sizes))
        margin += trees[-1].scores(block["bins"])
        auroc = ranked_auroc(_ranked(block, margin)) if block["stop"].any() else None
        if auroc is not None:
            history.append(auroc)
            if len(history) - 1 - int(np.argmax(history)) >= fit.settings.patience:
                break
    return trees, history


def _met(a, b):
    return a + b if a.ndim == 3 else _rank_sum(a, b)


def value_counts(sets: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training rows by set, feature and value: _set, feature, _value, _n. Tasks count before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        many = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                values = np.concatenate(parts)
                for i, f in enumerate(features):
                    found, n = np.unique(values[:, i][~np.isnan(values[:, i])] + 0.0, return_counts=True)
                    for at in range(0, len(found), BLOCK):
                        own = found[at : at + BLOCK]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array([f] * len(own)), pa.array(own), pa.array(n[at : at + BLOCK])], ["_set", "feature", "_value", "_n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column("_set").to_pylist(), object)
            values = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(names), len(features))
            for name in dict.fromkeys(names.tolist()):
                held.setdefault(name, []).append(values[names == name])
            many += len(names)
            if many >= DEALT:
                yield from out()
                many = 0
        yield from out()

    train = sets.where(~F.col("_stop")).select("_set", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    counted = train.mapInArrow(count, "_set string, feature string, _value double, _n long")
    return materialised(counted.groupBy("_set", "feature", "_value").agg(F.sum("_n").alias("_n")))


def _edges(counts: DataFrame, bins: int) -> dict[tuple[str, str], np.ndarray]:
    """Cuts per row set and feature: distinct quantiles of its training rows (``value_counts``), at most ``bins`` - 1 of them."""
    probs = [i / bins for i in range(1, bins)]
    rows = weighted_quantiles(counts, ["_set", "feature"], "_value", {"all": "_n"}, probs).collect()  # sets x features x bins numbers
    out: dict[tuple[str, str], set] = {}
    for r in rows:
        out.setdefault((r["_set"], r["feature"]), set()).add(r["value"] + 0.0)
    return {k: np.array(sorted(v)) for k, v in out.items()}


#: The columns of a block in bytes: what names a cell, its number of rows, and the keys of its rows, cell by cell.
NAMED = {"y": np.float64, "w": np.float64, "stop": bool}
BYTES = {"bins": np.uint8, **NAMED, "n": np.uint32, "k0": np.uint32, "k1": np.uint32}


def _cell_names(part: Mapping) -> np.ndarray:
    """Bytes that name each cell, as rows of whole 64-bit words."""
    width = part["bins"].shape[1]
    size = width + sum(np.dtype(k).itemsize for k in NAMED.values())
    out = np.zeros((len(part["y"]), -(-size // 8) * 8), np.uint8)
    out[:, :width] = part["bins"]
    for name, kind in NAMED.items():
        own = np.ascontiguousarray(part[name], kind).view(np.uint8).reshape(len(out), -1)
        out[:, width : width + own.shape[1]] = own
        width += own.shape[1]
    return out.view(np.uint64)


def _mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def collapsed(parts: Sequence[Mapping]) -> tuple[dict, np.ndarray]:
    """Parts (blocks, or rows with ``n`` of 1) as one block, equal cells as one, and the cells' hashes."""
    whole = {c: np.concatenate([p[c] for p in parts]) for c in BYTES}
    words = _cell_names(whole)
    hashes = _mixed(words)
    found, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    if (words[first][place] != words).any():  # two cells with one hash
        _, first, place = np.unique(words, axis=0, return_index=True, return_inverse=True)
        place, found = place.reshape(-1), hashes[first]
    out = {c: whole[c][first] for c in ("bins", *NAMED)}
    out["n"] = np.bincount(place, whole["n"], len(first)).astype(np.uint32)
    order = np.argsort(np.repeat(place, whole["n"]), kind="stable") if len(whole["k0"]) else np.zeros(0, np.intp)
    return out | {k: whole[k][order] for k in ("k0", "k1")}, found


def _dealt(block: Mapping, hashes: np.ndarray, chunks: int) -> Iterator[tuple[int, dict]]:
    """A block's cells by chunk; a cell of many rows is dealt in pieces of ``PIECE``."""
    if chunks == 1:
        yield 0, dict(block)
        return
    pieces = -(-block["n"].astype(np.int64) // PIECE)
    cell = np.repeat(np.arange(len(pieces)), pieces)
    turn = np.arange(len(cell)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    n = np.minimum(block["n"][cell] - turn * PIECE, PIECE).astype(np.uint32)
    chunk = (_mixed(np.stack([hashes[cell], turn.astype(np.uint64)], axis=1)) >> np.uint64(11)) % np.uint64(chunks)
    keyed, row_chunk = len(block["k0"]) > 0, np.repeat(chunk, n) if len(block["k0"]) else None
    for c in np.unique(chunk):
        own = np.flatnonzero(chunk == c)
        rows = np.flatnonzero(row_chunk == c) if keyed else np.zeros(0, np.intp)
        yield int(c), {**{x: block[x][cell[own]] for x in ("bins", *NAMED)}, "n": n[own], **{k: block[k][rows] for k in ("k0", "k1")}}


def _row_of(block: Mapping, **others) -> pa.RecordBatch:
    columns = {k: pa.array([v], pa.int32() if k == "place" else pa.string()) for k, v in others.items()}
    columns |= {c: pa.array([np.ascontiguousarray(block[c], kind).tobytes()], pa.binary()) for c, kind in BYTES.items()}
    return pa.RecordBatch.from_pydict(columns)


def _packed(
    sets: DataFrame, features: Sequence[str], edges: Mapping, chunks: Mapping[str, int], keyed: Collection[str] | None = None
) -> DataFrame:
    """Rows as blocks of bytes, one Spark row a chunk: its cells, and the keys of their rows in the sets ``keyed``, default all.

    Rows are counted by cell before they move; those of a cell meet in one chunk as far as a chunk can hold them.
    """
    columns = ", ".join(f"{c} binary" for c in BYTES)
    cuts = {s: [edges.get((s, f), np.zeros(0)) for f in features] for s in {k[0] for k in edges}}
    first = dict(zip(chunks, np.cumsum([0, *chunks.values()]).tolist()))
    keys = set(chunks if keyed is None else keyed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        many: dict[str, int] = {}

        def out(name: str) -> Iterator[pa.RecordBatch]:
            many.pop(name)
            block, hashes = collapsed(held.pop(name))
            for c, part in _dealt(block, hashes, chunks[name]):
                yield _row_of(part, set=name, place=first[name] + c)

        for batch in batches:
            names = np.array(batch.column("_set").to_pylist(), object)
            values = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(names), len(features))
            rows = {"y": "y", "w": "_w", "stop": "_stop"} | ({"k0": "_k0", "k1": "_k1"} if keys else {})
            rows = {c: batch.column(x).to_numpy(zero_copy_only=False).astype(BYTES[c]) for c, x in rows.items()}
            rows = {"n": np.ones(len(names), np.uint32), **rows}
            for name in dict.fromkeys(names.tolist()):
                own = np.flatnonzero(names == name)
                bins = binned(values[own], cuts.get(name, [np.zeros(0)] * len(features)))
                unkeyed = {} if name in keys else {"k0": np.zeros(0, np.uint32), "k1": np.zeros(0, np.uint32)}
                held.setdefault(name, []).append({"bins": bins, **{c: x[own] for c, x in rows.items()}, **unkeyed})
                many[name] = many.get(name, 0) + len(own)
                if many[name] >= DEALT:
                    yield from out(name)
        for name in list(held):
            yield from out(name)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for row in batch.to_pylist():
                parts.append((row["set"], _unpacked(row, len(features))))
        if parts:
            yield _row_of(collapsed([p for _, p in parts])[0], set=parts[0][0])

    rows = sets.select("_set", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), "y", "_w", "_stop", *(["_k0", "_k1"] if keys else []))
    dealt = rows.mapInArrow(deal, f"set string, place int, {columns}").repartitionById(sum(chunks.values()), F.col("place"))
    return materialised(dealt.mapInArrow(meet, f"set string, {columns}"))


def _together(blocks: Sequence[Mapping]) -> dict:
    """Blocks of a set as one."""
    return blocks[0] if len(blocks) == 1 else {"set": blocks[0]["set"], **{c: np.concatenate([b[c] for b in blocks]) for c in BYTES}}


def _fitted_where_they_lie(packed: DataFrame, fits: Mapping[str, Fit], starts: Mapping[str, float], sizes: Sequence[int]):
    """(name, trees, history) of fits whose set a task can hold: a task a fit holds its blocks."""
    names: dict[str, list[str]] = {}
    for name, f in fits.items():
        names.setdefault(f.rows, []).append(name)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                name = row["name"]
                blocks.append(_unpacked(row, len(sizes)))
        if blocks:
            block, fit = _together(blocks), fits[name]
            found = _fit_of_block(_with_cells(block, sizes), fit, starts[name], sizes)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pickle.dumps(found)], pa.binary())], ["name", "model"])

    each = F.create_map(*[x for k, own in names.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in own]))])[F.col("set")]
    order = {n: i for i, n in enumerate(fits)}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("name")]
    spread = packed.where(F.col("set").isin(list(names))).withColumn("name", F.explode(each)).repartitionById(len(fits), place)
    # trees and histories: bounded by the fits' parameters
    for r in spread.mapInArrow(grow, "name string, model binary").collect():
        yield r["name"], *pickle.loads(r["model"])


def _unpacked(row, width: int) -> dict:
    block = {c: np.frombuffer(row[c], kind) for c, kind in BYTES.items()}
    return {**block, "set": row["set"], "bins": block["bins"].reshape(len(block["y"]), width)}


def _with_cells(block: dict, sizes: Sequence[int]) -> dict:
    return {**block, "cells": _cells(block["bins"], sizes)}


def row_set(rows: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """A training set (id, y, features, optional _w and _stop) in the form that ``fit_many`` takes."""
    first, second = stream_key(seed, "id")
    weightless = {} if "_w" in rows.columns else {"_w": F.lit(1.0)}
    unheld = {} if "_stop" in rows.columns else {"_stop": F.lit(False)}
    return rows.withColumns({**weightless, **unheld, "_set": F.lit(name), "_k0": first, "_k1": second})


def _columns(fit: Fit, tree: int, n: int) -> list[int]:
    """The features a tree may use, in order."""
    k = max(1, round(n * fit.settings.columns))
    if k >= n:
        return list(range(n))
    return sorted(np.random.default_rng([fit.seed, tree]).choice(n, k, replace=False).tolist())


def fit_many(
    sets: Sequence[DataFrame], features: Sequence[str], fits: Sequence[Fit], bins: int = BINS, block_rows: int | None = None
) -> dict[str, Model]:
    """Fit all ``fits`` together; ``sets`` come from ``row_set`` and are read three times. Models by name.

    Sets of at most ``HELD`` rows (``block_rows``, if given) are one block, larger ones are cut into blocks. A larger set
    that is no more cells is held by tasks as well, if no fit draws rows of it or their keys are at most ``KEYS``.
    Bounded by parameters on the driver: cuts, trees, and one split per open node.
    """
    held, block_rows = (HELD, BLOCK) if block_rows is None else (block_rows, block_rows)
    features = list(features)
    spark = sets[0].sparkSession
    every = _stacked([s.select("_set", "y", *features, "_w", "_stop", "_k0", "_k1") for s in sets])
    edges = _edges(value_counts(every, features), bins)
    heads = {
        r["_set"]: r
        for r in every.groupBy("_set").agg(
            F.sum(F.when(~F.col("_stop"), F.col("_w"))).alias("w"), F.sum(F.when(~F.col("_stop"), F.col("_w") * F.col("y"))).alias("p"),
            F.max("_stop").alias("held"), F.count(F.lit(1)).alias("n"),
        ).collect()
    }
    sizes = [max(1 + len(edges.get((s, f), ())) for s in heads) for f in features]
    context = spark.sparkContext
    ensure_checkpoint_dir(spark)
    cores = max(1, context.defaultParallelism)
    chunks = {name: 1 if r["n"] <= held else -(-r["n"] // block_rows) for name, r in heads.items()}
    drawn = {f.rows for f in fits if f.settings.rows < 1.0}
    packed = _packed(every, features, edges, chunks, drawn)

    models: dict[str, Model] = {}
    by_set: dict[str, list[str]] = {}
    for f in fits:
        r = heads[f.rows]
        share = r["p"] / r["w"] if r["w"] else 0.5
        start = float(np.log(share / (1 - share))) if f.settings.from_mean and 0 < share < 1 else 0.0
        models[f.name] = Model(features, [edges.get((f.rows, x), np.zeros(0)) for x in features], start, [])
        by_set.setdefault(f.rows, []).append(f.name)
    starts = {f.name: models[f.name].start for f in fits}
    count = len(features)
    lies = {r["set"]: r for r in packed.groupBy("set").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("n") / 4).alias("cells")).collect()}
    blocks_of = {k: r["blocks"] for k, r in lies.items()}
    few = {k for k, r in lies.items() if r["blocks"] == 1 or r["cells"] <= held and (k not in drawn or heads[k]["n"] <= KEYS)}
    small = {f.name: f for f in fits if f.rows in few and f.settings.rounds > 0}
    if small:
        for name, trees, history in _fitted_where_they_lie(packed, small, starts, sizes):
            models[name].trees, models[name].history = trees, history
    fits = [f for f in fits if f.name not in small]
    by_set = {k: [n for n in names if n not in small] for k, names in by_set.items()}
    wanted_sets, reducers = {k for k, names in by_set.items() if names}, max(1, min(len(fits), cores))

    def begin(block):
        return {n: np.full(len(block["y"]), starts[n]) for n in by_set[block["set"]]}

    blocks = margins = state = old = None
    if fits:
        spread = max(1, min(sum(blocks_of[k] for k in wanted_sets), cores))
        rows = packed.where(F.col("set").isin(list(wanted_sets))).rdd.coalesce(spread)
        blocks = _one_by_one(rows.map(lambda r: _with_cells(_unpacked(r, count), sizes))).persist(StorageLevel.MEMORY_AND_DISK)
        margins = _one_by_one(blocks.map(begin))
        state = blocks.zip(margins)

    running = {f.name: f for f in fits if f.settings.rounds > 0}
    last: dict[str, Tree] = {}
    turn = 0
    while running:
        before = margins
        if last:
            margins = _moved(state, last, turn)
            state = blocks.zip(margins)
        judged = {n for n, f in running.items() if heads[f.rows]["held"] and models[n].trees}
        more = {n: f for n, f in running.items() if len(models[n].trees) < f.settings.rounds}
        grown, ranks, kept = _grown(state, more, judged, models, sizes, reducers)
        for name in list(running):
            model, s = models[name], running[name].settings
            if name in ranks:
                model.history.append(ranks[name])
                best = int(np.argmax(model.history))
                if len(model.history) - 1 - best >= s.patience:
                    del running[name]
                    continue
            if name not in more:
                del running[name]
                continue
            model.trees.append(grown[name])
        last = {n: grown[n] for n in running}
        for rdd in [*kept, *([before] if before is not margins else [])]:
            rdd.unpersist()
        if margins is not None and margins.isCheckpointed():
            old = _superseded(context, old, margins.getCheckpointFile())
        turn += 1
    if fits:
        margins.unpersist()
        blocks.unpersist()
    for model in models.values():
        model.rounds = len(model.trees)
        if model.history:
            model.trees = model.trees[: int(np.argmax(model.history)) + 1]
    return models


def _stacked(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _moved(state, last: Mapping[str, Tree], turn: int):
    """The margins with the last round's trees added."""

    def add(x):
        block, margins = x
        return {n: m + last[n].scores(block["bins"]) for n, m in margins.items() if n in last}

    new = _one_by_one(state.map(add)).persist(StorageLevel.MEMORY_AND_DISK)
    if turn % CUT == 0:
        new.checkpoint()  # written with the first job that reads it
    return new


def _one_by_one(rdd):
    """Elements in batches of one, so that tables of the same blocks can be zipped as they lie."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _superseded(context, old: str | None, new: str) -> str:
    """Delete margins that newer ones have replaced; shuffles of past rounds go when the driver collects its garbage."""
    if old is not None and old != new:
        path = context._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        context._jvm.System.gc()
    return new


def _grown(state, fits: Mapping[str, Fit], held: set[str], models: Mapping[str, Model], sizes: Sequence[int], reducers: int):
    """One tree for each fit, the AUROC of ``held`` fits as they stand, and the persisted tables to let go."""
    growth = {n: Growth(f.settings) for n, f in fits.items()}
    tables, ranks, sums = [], {}, None
    wanted = {n: [(-1, 0, -1)] for n in fits}
    columns = {n: _columns(f, len(models[n].trees), len(sizes)) for n, f in fits.items()}
    first = True
    while wanted or (first and held):
        plans = {n: _plan(growth[n], ws, fits[n], len(models[n].trees)) for n, ws in wanted.items()}
        asked = held if first else set()

        def partial(x, plans=plans, asked=asked):
            block, margins = x
            for n, m in margins.items():
                if n in plans:
                    yield f"h:{n}", _node_sums(block, m, plans[n], sizes)
                if n in asked and block["stop"].any():
                    yield f"a:{n}", _ranked(block, m)

        met = state.flatMap(partial).reduceByKey(_met, reducers)
        if first:
            table = met.mapValues(lambda v: {0: v[0]} if v.ndim == 3 else v)
        else:
            keep_all = {n for n in wanted if fits[n].settings.growth == "leaf"}

            def siblings(x, wanted=wanted, keep_all=keep_all):
                (key, (own, before)) = x
                return key, _with_siblings(wanted[key[2:]], own, before, key[2:] in keep_all)

            table = met.join(sums, reducers).map(siblings, preservesPartitioning=True)
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        tables.append(table)
        nodes = {n: [0] if first else growth[n].fresh for n in wanted}
        settings = {n: fits[n].settings for n in wanted}

        def chosen(x, nodes=nodes, settings=settings):
            key, value = x
            if key[0] == "a":
                return key, value
            n = key[2:]
            return key, best_splits(np.stack([value[i] for i in nodes[n]]), sizes, columns[n], settings[n])

        for key, value in table.map(chosen).collect():
            if key[0] == "a":
                auroc = ranked_auroc(value)
                if auroc is not None:
                    ranks[key[2:]] = auroc
            else:
                growth[key[2:]].learn(value)
        sums = table
        wanted = {n: ws for n in wanted if n in growth and growth[n].found and (ws := growth[n].wanted())}
        first = False
    return {n: g.tree() for n, g in growth.items()}, ranks, tables

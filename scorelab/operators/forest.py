"""Random forests over histograms: trees grow in tasks, each by the same functions wherever its rows lie.

Training rows are binned once per row set and kept in blocks of cells (rows of equal bins, label and weight). A row's number of
draws for a tree (Poisson) and the features a node may use are hashes of the row, the tree and
the node's place, so a tree does not depend on tasks; a cell's draws are the sum of its rows'.

The trees of a set of at most ``HELD`` cells are spread over tasks that hold its cells and their draws, summed where the rows lie.
Larger sets stay in their blocks: nodes of more than ``HELD`` draws are split by one aggregate a level, keyed by tree,
and the cells of each smaller node then meet in one task, which grows the rest of the
tree below it. The driver holds the trees.

Where only scores of held-out rows are asked for (``held_out_scores``), the task that grows a tree of a one-block set
scores them and no tree leaves it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scorelab.functions.hashing import counter_block, poisson_block
from scorelab.operators import boosting
from scorelab.operators.boosting import Tree
from scorelab.session import materialised

#: Bins per feature; cells (or draws of a node of a larger set) from which one task grows a tree; rows of a block.
BINS, HELD, BLOCK = 32, 524_288, 65_536
#: Trees of a task, trees of a larger set that grow together, nodes whose sums are held at once.
GROUP, TOGETHER, NODES = 16, 32, 4096
#: Scored cells that a task remembers.
KNOWN = 200_000
#: Tasks a core of a plan whose trees stay in their tasks.
WAVES = 16


@dataclass(frozen=True)
class Settings:
    """``columns``: the features a node may use, "sqrt", "log2" or "all"."""

    trees: int = 300
    depth: int = 12
    min_rows: int = 1
    columns: str = "sqrt"

    def drawn(self, n: int) -> int:
        sizes = {"sqrt": np.ceil(np.sqrt(n)), "log2": np.ceil(np.log2(n)), "all": n}
        return max(1, int(sizes[self.columns]))


@dataclass(frozen=True)
class Fit:
    """One model: ``rows`` names its row set."""

    name: str
    rows: str
    settings: Settings
    seed: int = 42


@dataclass
class Forest(boosting.Model):
    """A fitted forest; a node's value is its share of class 1."""

    @property
    def stages(self) -> list:
        return [self]

    def scores(self, values: np.ndarray) -> np.ndarray:
        """The mean of the trees' shares."""
        return self.of_bins(self.bins(values))

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.scores(bins)
        return total / max(1, len(self.trees))

    def score(self, *columns: Column) -> Column:
        """The probability of class 1, from the features in order."""
        none = np.zeros(0)
        model = Forest(self.features, self.edges, 0.0, [replace(t, gain=none, cover=none) for t in self.trees])
        known: dict[bytes, float] = {}  # of a task: rows of equal bins are scored once

        @F.arrow_udf(DoubleType())
        def predicted(values: pa.Array) -> pa.Array:
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            bins = model.bins(rows)
            cells = bins.view(f"V{bins.shape[1]}")[:, 0].tolist()
            new = {c: i for i, c in enumerate(cells) if c not in known}
            if new:
                if len(known) > KNOWN:
                    known.clear()
                    new = {c: i for i, c in enumerate(cells)}
                known.update(zip(new, model.of_bins(bins[list(new.values())]).tolist()))
            return pa.array([known[c] for c in cells], pa.float64())

        return predicted(F.array(*[c.cast("double") for c in columns]))

    def importances(self) -> list[tuple[str, float]]:
        """Mean over trees of each feature's share of the tree's impurity decrease."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner] * tree.cover[inner], len(total))
            total += own / own.sum() if own.sum() else 0.0
        whole = total.sum()
        return list(zip(self.features, (total / whole if whole else total).tolist()))


# --- splits --------------------------------------------------------------------


def _may_use(path: np.ndarray, tree: int, seed: int, n: int, drawn: int) -> np.ndarray:
    """The features of each node, in order; a node is named by its place, the root is 1 and children 2p and 2p + 1."""
    if drawn >= n:
        return np.tile(np.arange(n), (len(path), 1))
    first = (path.astype(np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)
    second = np.full(len(path), (tree * 0x85EBCA6B + seed * 0xC2B2AE35 + 1) & 0xFFFFFFFF, np.uint32)
    bits = counter_block(first, second, 1, n)
    return np.sort(np.argsort(bits, axis=1, kind="stable")[:, :drawn], axis=1)


def _sums(bins: np.ndarray, y: np.ndarray, w: np.ndarray, draws: np.ndarray, slot: np.ndarray, used: np.ndarray, width: int, count: bool):
    """Weights by node, used feature, bin and class; with ``count`` also draws by node, used feature and bin."""
    nodes, m = used.shape
    weights, rows = np.empty((nodes, m, width, 2)), np.empty((nodes, m, width)) if count else None
    cells, first = np.ascontiguousarray(bins).reshape(-1), np.arange(len(slot)) * bins.shape[1]
    place = slot * (2 * width) + y
    for j in range(m):
        at = np.left_shift(cells.take(first + used[:, j].take(slot)), 1, dtype=np.intp) + place
        weights[:, j] = np.bincount(at, w, nodes * width * 2).reshape(nodes, width, 2)
        if count:
            rows[:, j] = np.bincount(at, draws, nodes * width * 2).reshape(nodes, width, 2).sum(axis=2)
    return weights, rows


def best_splits(weights: np.ndarray, rows: np.ndarray | None, used: np.ndarray, s: Settings):
    """Per node: gain (decrease of the Gini impurity; 0 for none), feature, cut. Ties go to the earlier feature and cut."""
    # each class on its own: sums over an axis of two are slow
    low = [np.cumsum(weights[..., k], axis=2) for k in (0, 1)]
    high = [x[:, :, -1:] - x[:, :, :-1] for x in low]
    total, low = [x[:, :, -1:] for x in low], [x[:, :, :-1] for x in low]
    nl, nr, n = (x[0] + x[1] for x in (low, high, total))
    fine = (nl > 0) & (nr > 0)
    if rows is not None:
        below = np.cumsum(rows, axis=2)
        fine &= np.minimum(below[:, :, :-1], below[:, :, -1:] - below[:, :, :-1]) >= s.min_rows

    def squares(x):
        return x[0] ** 2 + x[1] ** 2

    with np.errstate(divide="ignore", invalid="ignore"):
        kept = squares(low) / nl + squares(high) / nr
        gain = np.where(fine, (kept - squares(total) / n) / n, 0.0).reshape(len(used), -1)
    top = gain.max(axis=1)
    at = np.argmax(gain >= (top * (1 - 1e-9))[:, None], axis=1)
    place, cut = np.divmod(at, weights.shape[2] - 1)
    return np.where(top > 1e-12, top, 0.0), used[np.arange(len(used)), place], cut


def _joined(parts: Sequence[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind)


def grown(
    bins: np.ndarray, y: np.ndarray, w: np.ndarray, draws: np.ndarray, fit: Fit, tree: int, width: int, path: int = 1, level: int = 0
) -> Tree:
    """A tree, or what lies below the node at ``path``, from its rows (``w``: draws times weight). Nodes are numbered level by level."""
    s, n = fit.settings, bins.shape[1]
    paths, slot = np.array([path], np.int64), np.zeros(len(y), np.intp)  # rows lie by node
    y, known = y.astype(np.int64), 1
    out: list[tuple] = []
    while len(paths):
        ends = np.cumsum(np.bincount(slot, minlength=len(paths)))
        total = np.bincount(2 * slot + y, w, 2 * len(paths)).reshape(-1, 2)
        cover = total.sum(axis=1)
        gain, feature, cut = np.zeros(len(paths)), np.full(len(paths), -1), np.zeros(len(paths), np.int64)
        open_ = (total > 0).all(axis=1) if level < s.depth and width > 1 else np.zeros(len(paths), bool)
        if s.min_rows > 1:
            open_ &= np.bincount(slot, draws, len(paths)) >= 2 * s.min_rows
        for at in range(0, len(paths), NODES):
            own = at + np.flatnonzero(open_[at : at + NODES])
            if not len(own):
                continue
            first, last = ends[at - 1] if at else 0, ends[min(at + NODES, len(paths)) - 1]
            rows, now = slice(first, last), slot[first:last] - at
            if len(own) < min(NODES, len(paths) - at):
                place = np.full(NODES, -1)
                place[own - at] = np.arange(len(own))
                now = place.take(now)
                inside = np.flatnonzero(now >= 0)
                rows, now = first + inside, now.take(inside)
            used = _may_use(paths[own], tree, fit.seed, n, s.drawn(n))
            sums = _sums(bins[rows], y[rows], w[rows], draws[rows], now, used, width, s.min_rows > 1)
            gain[own], f, cut[own] = best_splits(*sums, used, s)
            feature[own] = np.where(gain[own] > 0, f, -1)
        split = feature >= 0
        left = np.where(split, known + 2 * (np.cumsum(split) - 1), -1)
        known += 2 * int(split.sum())
        value = np.divide(total[:, 1], cover, out=np.zeros(len(cover)), where=cover > 0)
        out.append((feature, cut, left, value, gain, cover))
        # rows of a split stay together: those that go left first
        if not split.all():
            rows = np.flatnonzero(split.take(slot))
            bins, y, w, draws, slot = bins.take(rows, axis=0), y.take(rows), w.take(rows), draws.take(rows), slot.take(rows)
        if not len(y):
            break
        high = bins.reshape(-1).take(np.arange(len(y)) * n + feature.take(slot)) > cut.take(slot)
        child = (2 * (np.cumsum(split) - 1)).take(slot) + high
        # a sort by radix where the children's numbers are short
        order = np.argsort(child.astype(np.uint16) if 2 * len(paths) <= 65_536 else child, kind="stable")
        bins, y, w, draws, slot = bins.take(order, axis=0), y.take(order), w.take(order), draws.take(order), child.take(order)
        paths = (2 * paths[split][:, None] + np.arange(2)).reshape(-1)
        level += 1
    feature, cut, left, value, gain, cover = zip(*out)
    left = _joined(left, np.int32)
    return Tree(_joined(feature, np.int16), _joined(cut, np.uint8), left, np.where(left >= 0, left + 1, -1).astype(np.int32), *(_joined(x, float) for x in (value, gain, cover)))


def pruned(tree: Tree) -> Tree:
    """Sibling leaves with the same class become one, from below, as in Spark ML's forests. Children come after their parents."""
    feature, says = tree.feature.copy(), tree.value > 0.5
    while True:
        inner = np.flatnonzero(feature >= 0)
        low, high = tree.left[inner], tree.right[inner]
        same = inner[(feature[low] < 0) & (feature[high] < 0) & (says[low] == says[high])]
        if not len(same):
            break
        feature[same] = -1
    kept, now = np.zeros(len(feature), bool), np.array([0])
    while len(now):
        kept[now] = True
        now = now[feature[now] >= 0]
        now = np.concatenate([tree.left[now], tree.right[now]])
    number, inner = np.cumsum(kept) - 1, feature >= 0
    left, right = (np.where(inner, number[x], -1)[kept].astype(np.int32) for x in (tree.left, tree.right))
    return Tree(feature[kept], np.where(inner, tree.cut, 0)[kept].astype(np.uint8), left, right, tree.value[kept], np.where(inner, tree.gain, 0.0)[kept], tree.cover[kept])


def _draws(block: Mapping, tree: int) -> np.ndarray:
    """How often the rows of each cell of a block are drawn for a tree."""
    return boosting.per_cell(block, lambda k0, k1: poisson_block(counter_block(k0, k1, tree + 1, tree + 1))[:, 0])


def _of_block(block: Mapping, fit: Fit, tree: int, width: int, draws: np.ndarray | None = None) -> Tree:
    draws = _draws(block, tree) if draws is None else draws
    own = np.flatnonzero((draws > 0) & (block["w"] > 0))
    draws = draws[own]
    return pruned(grown(block["bins"][own], block["y"][own], block["w"][own] * draws, draws, fit, tree, width))


# --- sets of many blocks -------------------------------------------------------


class _Top:
    """The upper part of one tree on the driver: nodes by number, their places, levels and draws."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value, self.gain, self.cover = [-1], [0], [-1], [0.0], [0.0], [0.0]
        self.path, self.level = [1], [0]
        self.open, self.rest = [0], []  # nodes to split by aggregates, and those whose rows meet in a task

    def tree(self) -> Tree:
        left = np.array(self.left, np.int32)
        return Tree(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), left, np.where(left >= 0, left + 1, -1).astype(np.int32),
                    np.array(self.value), np.array(self.gain), np.array(self.cover))

    def learn(self, found: Sequence[tuple], s: Settings, held: int) -> None:
        """Splits of the open nodes: (class weights, draws, gain, feature, cut, draws left)."""
        asked, self.open = self.open, []
        for node, (total, rows, gain, feature, cut, low) in zip(asked, found, strict=True):
            self.cover[node] = float(total.sum())
            self.value[node] = float(total[1] / total.sum()) if total.sum() else 0.0
            if gain <= 0 or self.level[node] >= s.depth:
                continue
            self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.path)
            for i, size in enumerate((low, rows - low)):
                (self.open if size > held else self.rest).append(len(self.path))
                self.path.append(2 * self.path[node] + i)
                self.level.append(self.level[node] + 1)
                for column, none in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
                    column.append(none)


def _with_rest(top: Tree, rest: Mapping[int, Tree]) -> Tree:
    """A tree and the parts below some of its nodes as one: a part's root takes the node's place."""
    columns = [[getattr(top, k).copy()] for k in ("feature", "cut", "left", "right", "value", "gain", "cover")]
    known = len(top.feature)
    for node, part in rest.items():
        for column, own in zip(columns, (part.feature, part.cut, *(np.where(x >= 0, x + known - 1, -1).astype(np.int32) for x in (part.left, part.right)), part.value, part.gain, part.cover)):
            column[0][node] = own[0]
            column.append(own[1:])
        known += len(part.feature) - 1
    return Tree(*(np.concatenate(c) for c in columns))


def _of_many_blocks(packed: DataFrame, fit: Fit, width: int, n: int, held: int) -> list[Tree]:
    """The trees of one fit, ``TOGETHER`` at a time."""
    blocks = packed.where(F.col("set") == fit.rows)
    s, out = fit.settings, []
    for at in range(0, s.trees, TOGETHER):
        tops = {t: _Top() for t in range(at, min(at + TOGETHER, s.trees))}
        while asked := {t: (top.tree(), np.array(top.open), np.array([top.path[i] for i in top.open])) for t, top in tops.items() if top.open}:

            def partial(row, asked=asked):
                block = boosting._unpacked(row.asDict(), n)
                for t, (tree, nodes, path) in asked.items():
                    draws = _draws(block, t)
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    own = np.flatnonzero((draws > 0) & (block["w"] > 0))
                    slot = place[tree.nodes(block["bins"][own])]
                    own, slot = own[slot >= 0], slot[slot >= 0]
                    used = _may_use(path, t, fit.seed, n, s.drawn(n))
                    yield t, _sums(block["bins"][own], block["y"][own].astype(np.int64), block["w"][own] * draws[own], draws[own], slot, used, width, True)

            def chosen(x, asked=asked):
                t, (weights, rows) = x
                used = _may_use(asked[t][2], t, fit.seed, n, s.drawn(n))
                gain, feature, cut = best_splits(weights, rows, used, s)
                place, each = np.argmax(used == feature[:, None], axis=1), np.arange(len(used))
                low = np.cumsum(rows, axis=2)[each, place, cut]
                return t, list(zip(weights[:, 0].sum(axis=1), rows[:, 0].sum(axis=1).tolist(), gain.tolist(), feature.tolist(), cut.tolist(), low.tolist()))

            met = blocks.rdd.flatMap(partial).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(asked))
            for t, found in met.map(chosen).collect():  # one split per open node
                tops[t].learn(found, s, held)
        rest = _rests(blocks, fit, {t: top for t, top in tops.items() if top.rest}, width, n)
        out += [pruned(_with_rest(top.tree(), rest.get(t, {}))) for t, top in tops.items()]
    return out


def _rests(blocks: DataFrame, fit: Fit, tops: Mapping[int, _Top], width: int, n: int) -> dict[int, dict[int, Tree]]:
    """What lies below the nodes that are small enough, by tree and node: their rows meet in a task."""
    if not tops:
        return {}
    places = {t: (top.tree(), np.array(top.rest), [(top.path[i], top.level[i]) for i in top.rest]) for t, top in tops.items()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = boosting._unpacked(row, n)
                for t, (tree, nodes, _) in places.items():
                    draws = _draws(block, t)
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    own = np.flatnonzero((draws > 0) & (block["w"] > 0))
                    slot = place[tree.nodes(block["bins"][own])]
                    order = np.argsort(slot, kind="stable")
                    own, slot = own[order], slot[order]
                    ends = np.searchsorted(slot, np.arange(len(nodes) + 1))
                    parts = [own[a:b] for a, b in zip(ends, ends[1:])]
                    has = [i for i, part in enumerate(parts) if len(part)]
                    if not has:
                        continue
                    bytes_ = [[x[parts[i]].astype(kind).tobytes() for i in has] for x, kind in ((block["bins"], np.uint8), (block["y"], np.uint8), (block["w"], float), (draws, np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(has), pa.int32()), pa.array(has, pa.int32()), *[pa.array(b, pa.binary()) for b in bytes_]], ["tree", "slot", "bins", "y", "w", "draws"])

    def below(table: pa.Table) -> pa.Table:
        t, i = table["tree"][0].as_py(), table["slot"][0].as_py()
        bins, y, w, draws = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table[c]]) for c, kind in (("bins", np.uint8), ("y", np.uint8), ("w", float), ("draws", np.uint32)))
        path, level = places[t][2][i]
        made = grown(bins.reshape(len(y), n), y, w * draws, draws, fit, t, width, path, level)
        return pa.table({"tree": pa.array([t], pa.int32()), "slot": pa.array([i], pa.int32()), "part": pa.array([pickle.dumps(made)], pa.binary())})

    rows = blocks.mapInArrow(dealt, "tree int, slot int, bins binary, y binary, w binary, draws binary")
    made = materialised(rows.groupBy("tree", "slot").applyInArrow(below, "tree int, slot int, part binary"))
    out: dict[int, dict[int, Tree]] = {}
    for r in made.toLocalIterator():
        out.setdefault(r["tree"], {})[int(places[r["tree"]][1][r["slot"]])] = pickle.loads(r["part"])
    return out


# --- fits ----------------------------------------------------------------------


def _edges(sets: DataFrame, features: Sequence[str], bins: int) -> dict[tuple[str, str], np.ndarray]:
    """Cuts per row set and feature: all values of a feature with fewer than ``bins``, else distinct quantiles."""
    values = boosting.value_counts(sets, features)
    found = boosting._edges(values, bins)
    few = values.groupBy("_set", "feature").agg(F.count("_value").alias("n")).where(F.col("n") < bins)
    for r in values.join(F.broadcast(few), ["_set", "feature"]).groupBy("_set", "feature").agg(F.sort_array(F.collect_set("_value")).alias("v")).collect():
        found[r["_set"], r["feature"]] = np.unique(np.array(r["v"], float) + 0.0)
    return found


def _blocks(sets: Sequence[DataFrame], features: Sequence[str], bins: int, block_rows: int | None):
    """Packed rows, cuts, rows and bins by set; a set is one block without ``block_rows``."""
    wide = ["_set", "y", *features, "_w", F.lit(False).alias("_stop"), "_k0", "_k1"]
    every = boosting._stacked([s.select(*wide) for s in sets])
    edges = _edges(every, features, bins)
    sizes = {r["_set"]: r["count"] for r in every.groupBy("_set").count().collect()}
    chunks = {name: 1 if block_rows is None else -(-n // block_rows) for name, n in sizes.items()}
    width = {name: 1 + max(len(edges.get((name, f), ())) for f in features) for name in sizes}
    return boosting._packed(every, features, edges, chunks), edges, sizes, width


def _asked(rows: DataFrame, features: Sequence[str], edges: Mapping) -> DataFrame:
    """Held-out rows (_set, row_id, y, features) as one row a set: set, ids, labels, their bins as bytes."""
    kinds = dict(rows.dtypes)
    cuts = {s: [edges.get((s, f), np.zeros(0)) for f in features] for s in {k[0] for k in edges}}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            names = np.array(batch.column("_set").to_pylist(), object)
            values = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(names), len(features))
            for name in dict.fromkeys(names.tolist()):
                own = np.flatnonzero(names == name)
                part = batch.take(pa.array(own))
                found.setdefault(name, []).append((part.column("row_id"), part.column("y"), boosting.binned(values[own], cuts[name])))
        for name, parts in found.items():
            ids, ys = (pa.concat_arrays([x[i] for x in parts]) for i in (0, 1))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, ys)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *lists, pa.array([np.concatenate([x[2] for x in parts]).tobytes()], pa.binary())], ["set", "ids", "ys", "asked"])

    slim = rows.select("_set", "row_id", "y", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    packed = slim.repartition("_set").mapInArrow(pack, f"set string, ids array<{kinds['row_id']}>, ys array<{kinds['y']}>, asked binary")
    return materialised(packed)


def held_out_scores(sets: Sequence[DataFrame], asked: DataFrame, features: Sequence[str], fits: Sequence[Fit], bins: int = BINS) -> DataFrame:
    """Scores of held-out rows by the forests of their set: name, row_id, y, p.

    ``sets`` come from ``boosting.row_set``, ``asked`` has _set, row_id, y and the features; of either a set has at
    most ``HELD`` rows. What leaves a task is a sum of its trees' shares per held-out row.
    """
    features, spark = list(features), asked.sparkSession
    packed, edges, sizes, width = _blocks(sets, features, bins, None)
    if any(n > HELD for n in sizes.values()):
        raise ValueError(f"a set has more than {HELD} rows")
    n, by_name = len(features), {f.name: f for f in fits}
    rows = _asked(asked, features, edges)
    cores = max(1, spark.sparkContext.defaultParallelism)
    each = max(GROUP, -(-sum(f.settings.trees for f in fits) // (WAVES * cores)))
    # deep trees first, so that the last tasks are short ones
    order = sorted(fits, key=lambda f: -f.settings.depth)
    jobs = [(f.name, f.rows, first, i) for i, (f, first) in enumerate((f, first) for f in order for first in range(0, f.settings.trees, each))]
    wanted = spark.createDataFrame(jobs, "name string, set string, first int, place int")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fit, block = by_name[row["name"]], boosting._unpacked(row, n)
                held_out = np.frombuffer(row["asked"], np.uint8).reshape(-1, n)
                total = np.zeros(len(held_out))
                for t in range(row["first"], min(row["first"] + each, fit.settings.trees)):
                    total += _of_block(block, fit, t, width[fit.rows]).scores(held_out)
                yield pa.RecordBatch.from_arrays([pa.array([fit.name]), pa.array([row["first"]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "first", "total"])

    def mean(table: pa.Table) -> pa.Table:
        fit = by_name[table["name"][0].as_py()]
        total = sum(np.frombuffer(b.as_buffer()) for b in table.sort_by("first")["total"])
        p = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total / fit.settings.trees))
        return pa.table({"name": pa.array([fit.name]), "set": pa.array([fit.rows]), "p": p})

    spread = packed.join(rows.select("set", "asked"), "set").join(F.broadcast(wanted), "set").repartitionById(len(jobs), F.col("place"))
    sums = materialised(spread.mapInArrow(grow, "name string, first int, total binary"))
    scored = sums.groupBy("name").applyInArrow(mean, "name string, set string, p array<double>").join(rows.select("set", "ids", "ys"), "set")
    one = F.explode(F.arrays_zip("ids", "ys", "p")).alias("s")
    return scored.select("name", one).select("name", F.col("s.ids").alias("row_id"), F.col("s.ys").alias("y"), "s.p")


def fit_many(
    sets: Sequence[DataFrame], features: Sequence[str], fits: Sequence[Fit], bins: int = BINS, held: int = HELD, block_rows: int = BLOCK
) -> dict[str, Forest]:
    """Fit all ``fits`` together; ``sets`` come from ``boosting.row_set``. Models by name."""
    features = list(features)
    packed, edges, _, width = _blocks(sets, features, bins, block_rows)
    n = len(features)
    models = {f.name: Forest(features, [edges.get((f.rows, x), np.zeros(0)) for x in features], 0.0, []) for f in fits}
    cells = {r["set"]: r["n"] for r in packed.groupBy("set").agg(F.sum(F.octet_length("n") / 4).alias("n")).collect()}
    whole = {f.name: f for f in fits if cells[f.rows] <= held}
    # deep trees first, so that the last tasks are short ones
    jobs = [(f, first) for f in sorted(whole.values(), key=lambda f: -f.settings.depth) for first in range(0, f.settings.trees, GROUP)]
    by_set: dict[str, dict[int, list]] = {}
    for i, (f, first) in enumerate(jobs):
        by_set.setdefault(f.rows, {}).setdefault(first, []).append((i, min(GROUP, f.settings.trees - first)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = boosting._unpacked(row, n)
                for first, places in by_set[row["set"]].items():
                    draws = np.stack([_draws(block, first + i) for i in range(max(many for _, many in places))]).astype(np.uint32)
                    narrow = np.uint8 if draws.max(initial=0) < 256 else np.uint32
                    for i, many in places:
                        own = np.ascontiguousarray(draws[:many]).astype(narrow)
                        kept = [pa.array([x], pa.binary()) for x in (row["bins"], block["y"].astype(np.uint8).tobytes(), row["w"], own.tobytes())]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.itemsize], pa.int32()), *kept], ["place", "size", "bins", "y", "w", "draws"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, place = [], -1
        for batch in batches:
            for row in batch.to_pylist():
                place, y = row["place"], np.frombuffer(row["y"], np.uint8)
                draws = np.frombuffer(row["draws"], np.uint8 if row["size"] == 1 else np.uint32).reshape(-1, len(y))
                parts.append((np.frombuffer(row["bins"], np.uint8).reshape(len(y), n), y, np.frombuffer(row["w"]), draws))
        if not parts:
            return
        (fit, first), block = jobs[place], {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("bins", "y", "w"))}
        for i in range(len(parts[0][3])):
            tree = _of_block(block, fit, first + i, width[fit.rows], np.concatenate([p[3][i] for p in parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([fit.name]), pa.array([first + i], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["name", "tree", "model"])

    if whole:
        drawn = packed.where(F.col("set").isin(list(by_set))).mapInArrow(dealt, "place int, size int, bins binary, y binary, w binary, draws binary")
        made = materialised(drawn.repartitionById(len(jobs), F.col("place")).mapInArrow(grow, "name string, tree int, model binary"))
        trees: dict[str, dict[int, Tree]] = {f: {} for f in whole}
        for r in made.toLocalIterator():
            trees[r["name"]][r["tree"]] = pickle.loads(r["model"])
        for name, own in trees.items():
            models[name].trees = [own[t] for t in sorted(own)]
    for f in fits:
        if f.name not in whole:
            models[f.name].trees = _of_many_blocks(packed, f, width[f.rows], n, held)
    for m in models.values():
        m.rounds = len(m.trees)
    return models

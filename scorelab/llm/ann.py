"""Approximate nearest neighbours by learned partitions.

Fitted on a bounded sample: a neighbour graph of the sample is cut into
partitions of equal size with few cut edges, and a small network learns to
predict, for a vector, the partitions of its neighbours. A third of the sample
is held out of both. Every row is indexed in its most probable partition. A query
goes to the most probable ones - as many as held-out queries need among held-out
rows for the recall asked for - and all rows there are ranked by exact cosine in
double precision on the original vectors.

Partitions of any size are split by a hash of the id into groups of a bounded
size, so a partition that holds a third of all rows (a very common vector) is
many tasks. A group is held by one task, past which the queries routed to it stream;
only when very many queries meet it is it sent more than once (lanes). A task returns at most k rows per
query; nothing is dropped before ranking.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null id or with a length that is not the most common one
(ties: the longer). Rows that repeat an id are rows of their own; a query
leaves out every row with its own id. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.llm import vectors
from scorelab.llm.common import stored

#: Rows that the graph and the network are fitted on, at most.
SAMPLE = 8_192
#: Recall that the number of visited partitions is chosen for, on the sample.
RECALL = 0.97
#: Neighbours in the graph, hidden units, training rounds.
GRAPH, HIDDEN, ROUNDS = 10, 128, 60
#: Rows of a group, queries of a lane.
CHUNK, LANE = 32_768, 262_144
FOUND = "query_id long, query_no long, vec_id long, score double"


def usable(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    kept = table.where(vectors.finite(column)).where(F.exists(column, lambda x: x != 0) & F.col("vec_id").isNotNull())
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("v"))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def graph(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row, by cosine."""
    k = min(k, len(rows) - 1)
    out = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 1024):
        near = rows[at : at + 1024] @ rows.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced(rows: np.ndarray, edges: np.ndarray, parts: int, slack: float = 0.05, sweeps: int = 12) -> np.ndarray:
    """Cut the graph into ``parts`` parts of nearly equal size.

    Starts from repeated median splits along the widest direction; then nodes
    move to the part that holds most of their neighbours while it has room.
    """
    label = np.zeros(len(rows), np.int64)
    for level in range(int(math.log2(parts))):
        for p in range(2**level):
            own = np.flatnonzero(label == p)
            if len(own) > 1:
                axis = np.linalg.svd(rows[own] - rows[own].mean(axis=0), full_matrices=False)[2][0]
                upper = own[np.argsort(rows[own] @ axis, kind="stable")[len(own) // 2 :]]
                label[upper] = p + 2**level
    into = [[] for _ in rows]  # both directions of an edge count
    for node, others in enumerate(edges):
        for o in others:
            into[o].append(node)
    around = [np.concatenate([e, np.array(i, np.int64)]) for e, i in zip(edges, into, strict=True)]
    size, most = np.bincount(label, minlength=parts), math.ceil((1 + slack) * len(rows) / parts)
    for _ in range(sweeps):
        moved = 0
        for node, near in enumerate(around):
            votes = np.bincount(label[near], minlength=parts)
            votes = np.where((size < most) | (np.arange(parts) == label[node]), votes, -1)
            best = int(votes.argmax())
            if votes[best] > votes[label[node]]:
                size[label[node]] -= 1
                size[best] += 1
                label[node] = best
                moved += 1
        if moved < len(rows) // 200:
            break
    return label


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer over unit vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(unit(rows) @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2


def train(rows: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 7) -> Router:
    """Fit the network to soft labels by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    d, parts = rows.shape[1], target.shape[1]
    p = [rng.normal(0, 1 / math.sqrt(d), (d, hidden)) * 2, np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    x, step = unit(rows), 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            h = np.maximum(x[b] @ p[0] + p[1], 0.0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - target[b]) / len(b)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x[b].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """The router and how many partitions a query must visit for ``recall``, both from ``sample``.

    Every third row is held out: the graph and the router never see it, and the
    visits are chosen for held-out rows as queries against all held-out rows.
    """
    rows = unit(sample)
    held = np.arange(len(rows)) % 3 == 2
    own = rows[~held]
    if len(own) <= 2 * parts or held.sum() <= 4 * k:
        return train(rows, np.full((len(rows), parts), 1.0 / parts), rounds=1), parts
    edges = graph(own, GRAPH)
    label = balanced(own, edges, parts)
    share = np.zeros((len(own), parts))
    np.add.at(share, (np.repeat(np.arange(len(own)), edges.shape[1]), label[edges].ravel()), 1.0 / edges.shape[1])
    share[np.arange(len(own)), label] += 1.0  # a row's own part and those of its neighbours
    router = train(own, share / share.sum(axis=1, keepdims=True))
    others = rows[held]
    logits = router.logits(others)
    home = logits.argmax(axis=1)
    near = graph(others, k)
    order = np.argsort(-logits, axis=1)
    place = (order[:, None, :] == home[near][:, :, None]).argmax(axis=2)
    for visits in range(1, parts + 1):
        if (place < visits).mean() >= recall:
            return router, visits
    return router, parts


def rank_exactly(asked: np.ndarray, own: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int):
    """``query place, name, score`` of the best ``k`` rows per query.

    A fast product picks what can be among them (with room for its rounding);
    those are measured again row by row, so equal vectors have equal scores.
    """
    long = np.sqrt((rows * rows).sum(axis=1))
    q_long = np.sqrt((asked * asked).sum(axis=1))
    fast = (asked / q_long[:, None]) @ (rows / long[:, None]).T
    fast[names[None, :] == own[:, None]] = -np.inf
    edge = -np.partition(-fast, min(k, fast.shape[1]) - 1, axis=1)[:, min(k, fast.shape[1]) - 1] - 1e-9
    i, j = np.nonzero((fast >= edge[:, None]) & np.isfinite(fast))
    score = np.concatenate([(asked[i[a : a + 65_536]] * rows[j[a : a + 65_536]]).sum(axis=1) for a in range(0, len(i), 65_536)] or [np.empty(0)])
    score = score / (q_long[i] * long[j])
    order = np.lexsort((names[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = place < k
    return i[keep], names[j[keep]], score[keep]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found; inputs as ``usable`` gives them."""
    spark = rows.sparkSession
    dims = vectors.common_width(rows, "v")
    rows, queries = rows.where(F.size("v") == dims), queries.where(F.size("v") == dims)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or min(256, max(16, 2 ** math.ceil(math.log2(max(1, total / 65_536)))))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(total)) < 2 * SAMPLE
    sample = np.array([r[0] for r in rows.where(share).select("v").limit(SAMPLE).collect()] or [rows.first()["v"]], float)
    router, visits = fit(sample, parts, k, recall)

    def routed(count: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                logits = router.logits(np.stack(frame["v"].to_numpy()).astype(float))
                order = np.argsort(-logits, axis=1, kind="stable")[:, :count]
                yield frame.assign(parts=list(order))

        return run

    schema = "vec_id long, v array<double>, parts array<long>"
    placed = rows.mapInPandas(routed(1), schema).select("vec_id", "v", F.col("parts")[0].alias("part"))
    index = stored(placed, "ann-index")
    asked = stored(queries.mapInPandas(routed(visits), schema).withColumn("query_no", F.monotonically_increasing_id()), "ann-queries")
    visited = asked.select("vec_id", "v", "query_no", F.explode("parts").alias("part"))
    # at most ``parts`` rows each
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    meets = {r["part"]: r["count"] for r in visited.groupBy("part").count().collect()}

    def per_part(numbers: dict) -> Column:
        return F.create_map(*[F.lit(x).cast("long") for pair in numbers.items() for x in pair])[F.col("part")]

    groups = per_part({p: math.ceil(n / CHUNK) for p, n in sizes.items()})
    lanes = per_part({p: math.ceil(meets.get(p, 0) / LANE) for p in sizes})
    zero = F.lit(0).cast("long")
    held = index.withColumn("sub", F.pmod(F.xxhash64("vec_id"), groups)).where(lanes > 0)
    held = held.withColumn("lane", F.explode(F.sequence(zero, lanes - 1)))
    streamed = visited.where(groups.isNotNull()).withColumn("lane", F.pmod(F.xxhash64("query_no"), lanes))
    streamed = streamed.withColumn("sub", F.explode(F.sequence(zero, groups - 1)))
    keys = ["part", "sub", "lane"]
    both = held.select(*keys, F.lit(-1).cast("long").alias("query_no"), "vec_id", "v").union(streamed.select(*keys, "query_no", "vec_id", "v"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, parts_held, rows_held = None, [], [], np.empty((0, 0))
        for batch in batches:
            code = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
            no, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query_no", "vec_id"))
            data = vectors.matrix(batch, "v")
            side = no >= 0
            cuts = np.flatnonzero((code[1:] != code[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(no)], strict=True):
                if a == b:
                    continue
                if group is None or (code[a] != group).any():
                    group, names, parts_held, rows_held = code[a], [], [], None
                if not side[a]:  # the group's rows come first
                    names.append(ids[a:b])
                    parts_held.append(data[a:b])
                    continue
                if rows_held is None:
                    rows_held, all_names = np.concatenate(parts_held), np.concatenate(names)
                for at in range(a, b, 128):
                    to = min(b, at + 128)
                    i, found, score = rank_exactly(data[at:to], ids[at:to], rows_held, all_names, k)
                    columns = [pa.array(ids[at:to][i], pa.int64()), pa.array(no[at:to][i], pa.int64()), pa.array(found, pa.int64()), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_no", "vec_id", "score"])

    met = both.repartition(*keys).sortWithinPartitions(*keys, "query_no").mapInArrow(compare, FOUND)
    return vectors.ranked(met, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

"""Exact top-k inner products by pivot-table elimination.

Pivots are a bounded number of rows, far from each other. Every row's distance to
each pivot is worked out once and stored beside it (the pivot table). For a query q and a row x, the largest
|d(q, p) - d(x, p)| over the pivots bounds their distance from below, hence the
inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Rows are evaluated in the
order of that bound, and a query stops when the next bound is below the k-th
score it has: nothing behind it can enter. The first k-th score comes from the
pivots themselves, which are rows too.

Rows lie in chunks of a bounded size, cut by range on (nearest pivot, distance,
id), so equal vectors spread over as many chunks as they need. The stated query
set is cut the same way into slices. Chunks and slices know the least and the largest distance to
each pivot and the largest norm, which bound every inner product between them:
pairs that cannot reach any query's first k-th score are dropped before a row is
sent. A chunk is then held by one task, past which its queries stream in blocks;
only when very many queries meet it is it sent more than once (lanes). A task returns at most k
rows per query and chunk.

Vectors that are null, or hold null or non-finite components, take no part; nor
do those whose length is not the most common one (ties: the longer).
Rows with a null id can be no one's neighbour and are left out. Rows that repeat
an id are rows of their own; a query leaves out every row with its own id. Other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm import vectors
from scorelab.llm.common import stored

#: Pivots, and rows from which they are chosen.
PIVOTS, PIVOT_SAMPLE = 24, 2048
#: Rows of a chunk, queries of a slice, slices at most (they grow beyond), and slices of a lane.
CHUNK, SLICE, SLICES, LANE = 8_192, 1_024, 4_096, 256
FOUND = "query_id long, query_no long, vec_id long, score long"
#: A block: ids, vectors, distances to the pivots as raw bytes; bounds: least and largest distances, norm, k-th score.
TABLE = "part long, no long, ids binary, data binary, gaps binary, bounds binary"


def choose_pivots(sample: np.ndarray, count: int) -> list[int]:
    """Places of distinct rows that are far from each other (farthest first)."""
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; squares of whole numbers are exact before the root."""
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def search(queries: np.ndarray, own: np.ndarray, to_query: np.ndarray, rows: np.ndarray, names: np.ndarray, to_row: np.ndarray,
           floor: np.ndarray, k: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ``k`` of ``rows`` for each query, no worse than ``floor``; also how many products were taken.

    ``to_query`` and ``to_row`` are the stored distances to the pivots. Evaluation
    goes in bound order, ``step`` rows at a time for all queries that still run.
    """
    gap = np.zeros((len(queries), len(rows)))
    for p in range(to_row.shape[1]):
        np.maximum(gap, np.abs(to_query[:, p : p + 1] - to_row[None, :, p]), out=gap)
    norms = (rows**2).sum(axis=1)
    own_norm = (queries**2).sum(axis=1)
    bound = (own_norm[:, None] + norms[None, :] - gap**2) / 2.0
    bound += 1e-9 * (own_norm[:, None] + norms[None, :]) + 1e-6  # covers the rounding of the roots
    order = np.argsort(-bound, axis=1)
    score = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    running, products = np.arange(len(queries)), 0
    for at in range(0, len(rows), step):
        part = order[running, at : at + step]
        kth = np.maximum(score[running, k - 1], floor[running])
        live = np.take_along_axis(bound[running], part[:, :1], 1)[:, 0] >= kth
        running, part = running[live], part[live]
        if not len(running):
            break
        product = np.einsum("qd,qrd->qr", queries[running], rows[part])
        products += product.size
        which = names[part]
        product[which == own[running][:, None]] = -np.inf
        score[running], found[running] = vectors.best(
            np.hstack([score[running], product]), np.hstack([found[running], which]), k
        )
    return score, found, products


def _with_gaps(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the distances to the pivots, the nearest pivot and its distance."""

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gaps = distances(np.stack(frame["v"].to_numpy()).astype(float), pivots)
            yield frame.assign(gaps=list(gaps), cell=gaps.argmin(axis=1), near=gaps.min(axis=1))

    return rows.mapInPandas(measured, "vec_id long, v array<double>, gaps array<double>, cell long, near double")


def _first_kth(asked: np.ndarray, own: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best inner product with the pivots, the query's own row left out."""
    if len(pivots) < k:
        return np.full(len(asked), -np.inf)
    scores = np.where(pivot_ids == own[:, None], -np.inf, asked @ pivots.T)
    return -np.sort(-scores, axis=1)[:, k - 1]


def _blocked(rows: DataFrame, parts: int, pivots: np.ndarray, pivot_ids: np.ndarray, k: int, name: str, per_block: int = 1024) -> DataFrame:
    """Rows with gaps, cut by range into ``parts`` and packed into blocks of ``TABLE``; stored."""
    cut = rows.repartitionByRange(parts, "cell", "near", "vec_id").sortWithinPartitions("cell", "near")

    def packed(batches: Iterator) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                some = batch.slice(at, per_block)
                ids = some.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                data, gaps = vectors.matrix(some, "v").astype(np.float64), vectors.matrix(some, "gaps")
                kth = _first_kth(data, ids, pivots, pivot_ids, k).min()
                bounds = np.concatenate([gaps.min(axis=0), gaps.max(axis=0), [(data**2).sum(axis=1).max(), kth]])
                part = some.column("part").to_pylist()[0]
                row = [part, no, ids.tobytes(), data.tobytes(), gaps.tobytes(), bounds.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "no", "ids", "data", "gaps", "bounds"])
                no += 1

    cut = cut.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "v", "gaps")
    return stored(cut.mapInArrow(packed, TABLE), name)


def _united(bounds: list[bytes], pivots: int) -> np.ndarray:
    """Bounds of several blocks as those of one."""
    every = np.array([np.frombuffer(b) for b in bounds])
    return np.concatenate([every[:, :pivots].min(axis=0), every[:, pivots : 2 * pivots].max(axis=0), [every[:, -2].max(), every[:, -1].min()]])


def may_meet(chunk: np.ndarray, slices: np.ndarray, pivots: int) -> np.ndarray:
    """Which slices (rows of bounds) may hold a query whose first k-th score a row of the chunk reaches."""
    apart = np.maximum(slices[:, :pivots] - chunk[None, pivots : 2 * pivots], chunk[None, :pivots] - slices[:, pivots : 2 * pivots])
    gap = np.maximum(apart.max(axis=1), 0.0)
    norms = slices[:, -2] + chunk[-2]
    return (norms - gap**2) / 2.0 + 1e-9 * norms + 1e-6 >= slices[:, -1]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` (long); both inputs have ``vec_id`` and ``v``, whole numbers as doubles."""
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    dims = vectors.common_width(rows, "v")
    rows = rows.where(F.size("v") == dims)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total))) < 2 * PIVOT_SAMPLE
    sample = rows.where(share).limit(PIVOT_SAMPLE).collect() or [rows.first()]
    places = choose_pivots(np.array([r["v"] for r in sample], float), pivots)
    chosen = np.array([sample[i]["v"] for i in places], float)
    pivot_ids, count = np.array([sample[i]["vec_id"] for i in places]), len(places)

    table = _blocked(_with_gaps(rows, chosen), max(math.ceil(total / CHUNK), 4), chosen, pivot_ids, k, "pivot-table")
    asked = queries.where(F.col("vec_id").isNotNull() & (F.size("v") == dims)).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    n_asked = asked.count()
    slices = max(1, min(SLICES, math.ceil(n_asked / SLICE)))
    blocks = _blocked(_with_gaps(asked, chosen), slices, chosen, pivot_ids, k, "query-blocks", 256)
    # one row of bounds per slice: at most SLICES of them
    slice_rows = blocks.groupBy("part").agg(F.collect_list("bounds").alias("bounds")).collect()
    known = np.array([r["part"] for r in slice_rows], np.int64)
    edges = np.array([_united(r["bounds"], count) for r in slice_rows]).reshape(len(known), 2 * count + 2)

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, bounds in zip(frame["part"], frame["bounds"], strict=True):
                met = known[may_meet(_united(list(bounds), count), edges, count)] if len(known) else known
                yield pd.DataFrame({"chunk": np.full(len(met), chunk), "slice": met, "lane": met // LANE})

    chunks = table.groupBy("part").agg(F.collect_list("bounds").alias("bounds"))
    meet = stored(chunks.mapInPandas(pairs, "chunk long, slice long, lane long"), "meeting-pairs")
    held = table.join(meet.select("chunk", "lane").distinct(), F.col("part") == F.col("chunk"))
    streamed = blocks.join(meet, F.col("part") == F.col("slice"))
    packed = ["ids", "data", "gaps"]
    both = held.select("chunk", "lane", F.lit(0).alias("side"), F.lit(0).cast("long").alias("part"), "no", *packed).union(
        streamed.select("chunk", "lane", F.lit(1).alias("side"), "part", "no", *packed)
    )

    def compare(batches: Iterator) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("chunk")[i].as_py(), batch.column("lane")[i].as_py())
                names, data = vectors.unpacked(batch.column("ids")[i].as_py(), batch.column("data")[i].as_py())
                gaps = np.frombuffer(batch.column("gaps")[i].as_py()).reshape(len(names), count)
                if key != group:
                    group, own = key, []
                if batch.column("side")[i].as_py() == 0:
                    own.append((names, data, gaps))
                    continue
                floor = _first_kth(data, names, chosen, pivot_ids, k)
                score, found = np.full((len(data), k), -np.inf), np.full((len(data), k), np.iinfo(np.int64).max)
                for row_names, block_rows, row_gaps in own:
                    s, f, _ = search(data, names, gaps, block_rows, row_names, row_gaps, np.maximum(floor, score[:, k - 1]), k)
                    score, found = vectors.best(np.hstack([score, s]), np.hstack([found, f]), k)
                q, j = np.nonzero(np.isfinite(score))
                no = (batch.column("part")[i].as_py() << 40) + (batch.column("no")[i].as_py() << 8) + q
                columns = [names[q], no, found[q, j], score[q, j].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_no", "vec_id", "score"])

    # a chunk's rows come first, then its queries stream past
    met = both.repartition("chunk", "lane").sortWithinPartitions("chunk", "lane", "side", "part", "no")
    return vectors.ranked(met.mapInArrow(compare, FOUND), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def quantised(table: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * component), without the vectors that take no part."""
    return table.where(vectors.finite(column)).select(
        "vec_id", F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v")
    )

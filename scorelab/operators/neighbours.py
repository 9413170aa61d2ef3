"""Exact k-nearest-neighbour join without a cross join.

Candidates are assigned to a bounded set of pivots. A query visits only cells
that can hold one of its k neighbours (triangle inequality against an upper
bound built from distances that are known to exist). Cells are cut into blocks of
bounded size on both sides, so a crowded cell spreads over many tasks, and a
block emits at most k rows per query (it is scanned with numpy, no pairs are made). Every cell that may matter is visited, so
the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorelab.session import materialised


def _pivot_matrix(candidates: DataFrame, pivots: int) -> np.ndarray:
    """``pivots`` vectors with the lowest id hashes: a parameter-bounded sample."""
    rows = candidates.orderBy(F.xxhash64("id"), "id").select("vec").limit(pivots).collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def knn_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    exclude_self: bool = False,
    pivots: int = 64,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest candidates of every query: query_id, id, distance, rank.

    Both inputs have ``id`` and ``vec`` (array of doubles). Ties are broken by id.
    With ``exclude_self`` a candidate with the query's own id is skipped.

    Copies are collapsed first, without loss: of equal candidate vectors only the
    lowest ids can ever be among the k nearest, and equal queries share an answer.
    """
    need = k + 1 if exclude_self else k
    same = F.xxhash64("vec")
    copies = Window.partitionBy("_h", "vec").orderBy("id")
    distinct = (
        candidates.select("id", "vec", same.alias("_h"))
        .withColumn("_r", F.row_number().over(copies))
        .where(F.col("_r") <= need)
        .select("id", "vec")
    )
    asked = queries.select("id", "vec", same.alias("_h"))
    groups = materialised(asked.groupBy("_h", "vec").agg(F.min("id").alias("_g")))
    found = _nearest(groups.select(F.col("_g").alias("id"), "vec"), distinct, need, pivots, block_rows)
    members = asked.join(groups, ["_h", "vec"]).select(F.col("id").alias("query_id"), "_g")
    answers = found.withColumnRenamed("query_id", "_g").join(members, "_g").drop("_g")
    if exclude_self:
        answers = answers.where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = answers.select("query_id", "id", "distance", rank.alias("rank"))
    return ranked.where(F.col("rank") <= k)


def closest(x: np.ndarray, y: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the ``need`` rows of y closest to each row of x; ties to the earlier row.

    One matrix product picks what can be among them, with room for its rounding;
    those are measured exactly.
    """
    long = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    fast = long - 2.0 * (x @ y.T)
    last = min(need, len(y)) - 1
    edge = np.partition(fast, last, axis=1)[:, last] + 1e-9 * long.max(axis=1)
    row, place = np.nonzero(fast <= edge[:, None])
    square = np.concatenate([((y[place[a : a + 65_536]] - x[row[a : a + 65_536]]) ** 2).sum(axis=1) for a in range(0, len(row), 65_536)])
    order = np.lexsort((place, square, row))
    row, place, square = row[order], place[order], square[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    kept = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < need
    return row[kept], place[kept], np.sqrt(square[kept])


#: Bytes of vectors in one block of the join, rows that a task assigns and queries that it routes at a time, and products of a block that it holds at once.
BLOCK_BYTES, ASSIGNED, ROUTED, PRODUCTS = 8_000_000, 1024, 128, 524_288


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False)


def closest_of_block(x: np.ndarray, y: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``closest`` for a whole block, so many queries at a time that the products stay within ``PRODUCTS``."""
    step = max(1, PRODUCTS // len(y))
    found = [closest(x[at : at + step], y, need) for at in range(0, len(x), step)]
    return np.concatenate([row + i * step for i, (row, _, _) in enumerate(found)]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))


def _nearest(
    queries: DataFrame, candidates: DataFrame, need: int, pivots: int, block_rows: int | None
) -> DataFrame:
    """The ``need`` nearest candidates of every query: query_id, id, distance."""
    spark = queries.sparkSession
    centres = _pivot_matrix(candidates, pivots)
    id_type = candidates.schema["id"].dataType
    if len(centres) == 0:
        schema = T.StructType(
            [T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", id_type),
             T.StructField("distance", T.DoubleType())]
        )
        return spark.createDataFrame([], schema)

    block_rows = block_rows or max(1024, BLOCK_BYTES // (8 * centres.shape[1]))

    def column(values: np.ndarray) -> pd.Series:
        return pd.Series(values) if values.dtype.kind in "iuf" else pd.Series(values.astype(object), dtype=object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ASSIGNED):
                batch = whole.slice(at, ASSIGNED)
                x = _vectors(pa.chunked_array([batch["vec"]]))
                dist = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)
                cell = dist.argmin(axis=1)
                near = pa.array(dist[np.arange(len(x)), cell])
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(cell, pa.int32()), near], ["id", "vec", "cell", "dist"])

    cell_schema = T.StructType(
        [*candidates.select("id", "vec").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]
    )
    cells = materialised(candidates.select("id", "vec").mapInArrow(assign, cell_schema))

    # statistics of at most ``pivots`` cells, k distances each
    nearest = cells.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(
        F.col("_r") <= need
    )
    near = nearest.groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("near"))
    stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    facts = {r["cell"]: r for r in stats.join(near, "cell").collect()}
    used = np.array(sorted(facts))
    low = np.array([facts[c]["lo"] for c in used])
    high = np.array([facts[c]["hi"] for c in used])
    known = np.full((len(used), need), np.inf)
    for i, c in enumerate(used):
        values = facts[c]["near"]
        known[i, : len(values)] = values
    blocks = {int(c): max(1, -(-int(facts[c]["n"]) // block_rows)) for c in used}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slack = 1e-9
        for pdf in batches:
            # a query leaves as one row per cell, with its vector: a few queries at a time bound what a task holds
            for at in range(0, len(pdf), ROUTED):
                ids, vecs = (pdf[c].iloc[at : at + ROUTED].to_numpy() for c in ("id", "vec"))
                x = np.stack(vecs).astype(float)
                dist = np.stack([np.sqrt(((x - centres[c]) ** 2).sum(axis=1)) for c in used], axis=1)
                reach = (dist[:, :, None] + known[None, :, :]).reshape(len(x), -1)
                position = min(need, reach.shape[1]) - 1
                bound = np.partition(reach, position, axis=1)[:, position]
                bound = bound + slack * (1.0 + np.abs(np.where(np.isfinite(bound), bound, 0.0)))
                visit = (dist - high[None, :] <= bound[:, None]) & (low[None, :] - dist <= bound[:, None])
                row, col = np.nonzero(visit)
                yield pd.DataFrame({"query_id": column(ids[row]), "qvec": column(vecs[row]), "cell": used[col].astype("int32")})

    query_type = queries.schema["id"].dataType
    route_schema = T.StructType(
        [T.StructField("query_id", query_type), T.StructField("qvec", queries.schema["vec"].dataType), T.StructField("cell", T.IntegerType())]
    )
    routed = materialised(queries.select("id", "vec").mapInPandas(route, route_schema))
    per_cell = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    query_blocks = {int(c): max(1, -(-int(n) // block_rows)) for c, n in per_cell.items()}

    def lookup(sizes: dict[int, int]):
        table = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair]) if sizes else F.create_map()
        return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(1))

    left = routed.withColumn("qb", F.pmod(F.xxhash64("query_id"), lookup(query_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), lookup(blocks) - 1))
    )
    right = cells.withColumn("cb", F.pmod(F.xxhash64("id"), lookup(blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), (lookup(query_blocks) - 1).cast("long")))
    )

    def nearest_in_block(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("id")
        row, place, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(q) and len(c):
            row, place, distance = closest_of_block(_vectors(q["qvec"]), _vectors(c["vec"]), need)
        return pa.table({"query_id": q["query_id"].take(pa.array(row)), "id": c["id"].take(pa.array(place)), "distance": pa.array(distance, pa.float64())})

    pair_schema = T.StructType(
        [T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())]
    )
    found = left.groupBy("cell", "cb", "qb").cogroup(right.groupBy("cell", "cb", "qb")).applyInArrow(
        lambda q, c: nearest_in_block(q, c), pair_schema
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= need).drop("_r")

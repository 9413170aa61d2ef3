"""What op 1, op 7 and op 13 share: which vectors take part, arrays of numbers, ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def finite(column: str = "embedding") -> Column:
    """True where a vector is there and every component is a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    lists = batch.column(name)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def common_width(rows: DataFrame, column: str) -> int:
    """The most common length of the vectors, of equally common ones the largest; 0 if there are none."""
    lengths = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return int(first["d"]) if first else 0


def unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(data, np.float64).reshape(len(names), -1)


def best(score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` largest scores, ties to the smaller name; -inf stands for nothing."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        keep = score >= edge
        most = int(keep.sum(axis=1).max())
        at = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        score = np.where(np.take_along_axis(keep, at, 1), np.take_along_axis(score, at, 1), -np.inf)
        names = np.take_along_axis(names, at, 1)
    order = np.lexsort((names, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each query's partial lists, ties to the smaller id.

    A query has at most ``k`` rows for each group it visited, never one per candidate.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

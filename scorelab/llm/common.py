"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.session import scratch_path

#: A word: a run of characters other than the ASCII blanks. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared scratch folder and read them back.

    Cuts the lineage (a lost executor cannot change what later steps see) and
    lets several readers use one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(texts: pa.Array, step: int = 256) -> Iterator[list]:
    """A batch's texts as Python strings, some at a time; what Arrow holds unused goes back in between.

    A worker keeps its process for many tasks and operators, so memory it holds on to adds up.
    """
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()
        pa.default_memory_pool().release_unused()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")

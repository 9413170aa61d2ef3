"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components.

64 bits are cut into four blocks of 16. Two fingerprints that differ in at most
two bits agree on at least two whole blocks, so every close pair shares one of
the six block pairs (32-bit keys: few chance meetings even among 10^9 prints).

A block key that more than ``bucket`` distinct prints share would cost their
square. Such prints are linked exactly without pairs: two prints are within two
bits if and only if some print is within one bit of both. Each sends itself and
its 64 one-bit neighbours, and all that meet at one of them are linked to the
smallest. Copies are collapsed to distinct prints before any of this.

Nulls and texts without words give fingerprint zero, which links like any other.
Rows with a null doc_id take part; a component without any doc_id has a null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scorelab.llm.common import in_slices, stored, text_or_empty, utf8
from scorelab.llm.graph import components

SEED = 42
BLOCKS = tuple(combinations(range(4), 2))
DISTANCE = 2


def fingerprint(text: str | None, width: int = 3, digest=xxhash.xxh64_intdigest) -> int:
    """Unsigned 64-bit majority of the shingle hashes; lower-cases A-Z only."""
    words = utf8(text).lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n <= width:
        return digest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    cuts = zip((ends - sizes)[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in cuts), np.uint64, n - width + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for some in in_slices(texts) for t in some], dtype=np.uint64).view(np.int64))


def _block_keys() -> str:
    def key(i: int, pair: tuple[int, int]) -> str:
        a, b = (f"(shiftrightunsigned(fp, {16 * k}) & 65535L)" for k in pair)
        return f"shiftleft({i}L, 32) | shiftleft({a}, 16) | {b}"

    return "array(" + ", ".join(key(i, p) for i, p in enumerate(BLOCKS)) + ")"


def close_links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges ``u, v`` over distinct prints (column ``fp``) that connect all pairs within two bits.

    Small buckets give the verified pairs themselves, large ones a set of edges
    with the same components. No pair within two bits is lost.
    """
    keyed = prints.select("fp", F.explode(F.expr(_block_keys())).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "blocks")
    few = shared.where(F.col("n") <= bucket).select("key", "fp")
    other = few.withColumnRenamed("fp", "gp")
    pairs = (
        few.join(other, "key")
        .where("fp < gp")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= DISTANCE)
        .select(F.col("gp").alias("u"), F.col("fp").alias("v"))
        .distinct()
    )
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    near = "concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))"
    middles = many.select("fp", F.explode(F.expr(near)).alias("middle"))
    least = middles.groupBy("middle").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = middles.join(least, "middle").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, bucket: int = 64) -> DataFrame:
    """One row per document: ``doc_id, fp`` (long), ``root`` (a print), ``component_id``."""
    printed = stored(docs.select("doc_id", fingerprint_of(text_or_empty()).alias("fp")), "prints")
    return printed.join(classes(printed, bucket), "fp")


def classes(printed: DataFrame, bucket: int = 64) -> DataFrame:
    """``fp, root, component_id`` per distinct print of ``printed`` (doc_id, fp)."""
    distinct = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    return named(distinct, close_links(distinct, bucket))


def named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of ``distinct`` (fp, first_id) under ``links`` (u, v)."""
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stored(rooted.join(names, "root").select("fp", "root", "component_id"), "classes")


def hex_print(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of close prints, with all its columns.

    That with the smallest doc_id (null ones last) stays; of rows that share it, the one whose text has the
    smallest hash, then the smallest row. Groups are decided on narrow rows; texts move once, to meet the
    (doc_id, hash of the text) of those that stay, so copies of one text never meet in one task.
    """
    mark = F.xxhash64("text")
    printed = stored(docs.select("doc_id", mark.alias("mark"), fingerprint_of(text_or_empty()).alias("fp")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")
    firsts = printed.groupBy("fp").agg(first).join(classes(printed), "fp")
    chosen = firsts.groupBy("root").agg(F.min("first").alias("first"))
    stays = chosen.select("root", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), mark.alias("own_mark"))
    met = held.join(stays, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_mark") == F.col("_mark")))
    maps = [n for n, t in docs.dtypes if "map<" in t]
    order = [F.to_json(F.struct(F.col("row")[n])) if n in maps else F.col("row")[n] for n in docs.columns]
    least = F.min_by("row", F.struct(*order)) if maps else F.min("row")
    return met.groupBy("root").agg(least.alias("row")).select("row.*")

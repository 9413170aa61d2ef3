"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges ``(u, v)`` with ``v < u``.

    Minima are aggregated before they meet the edges again, so a node with very
    many neighbours costs one partial aggregate per task.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``u, v``); the root is the smallest node.

    Nodes without an edge do not appear. Fails rather than return unfinished
    components (``max_rounds`` is far above the logarithmic number needed).
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        # the sum wraps round silently, so it is taken on a narrowed hash
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(found) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        mark = tuple(found)
        now = stored(_star(_star(now, True), False), "edges")
    raise RuntimeError("components did not settle")

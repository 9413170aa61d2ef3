"""Line dedup with SQL functions only: explode normalised lines, hash, count documents, drop, reassemble by position.

A line's key is the line without ASCII blanks at both ends, A-Z lower-cased. Keys
of at least ``least_chars`` code points that ``least_docs`` documents hold lose all
their lines, except in the document with the largest doc_id.

A document's distinct keys are found inside its row, so each document sends a key
once, as two 64-bit hashes with its doc_id; counts and the largest doc_id are
partial aggregates before any exchange, and a line that every document holds
costs a few rows a task. The common keys meet the lines' hashes and positions
(never the texts); what is dropped comes back to its document as sorted
positions, and the document is put together from the runs of lines between them.
Texts move once, to meet these positions.

Null and empty texts are one empty line. Every row is a document of its own: repeated
rows count each time, and all rows that have the largest doc_id keep their lines.
A null doc_id is smaller than any other. Very long texts, texts of blanks only
and ties need no special care; an empty table stays empty. Other columns stay as
they are, except that ``text`` holds what is left and added columns replace
columns of the same name. Two keys are one if both their hashes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import stored, text_or_empty

LEAST_CHARS, LEAST_DOCS = 20, 3
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks around it, A-Z lower-cased. ``lower`` is quick but right for ASCII only."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).when(bare.rlike("[A-Z]"), F.translate(bare, _UPPER, _LOWER)).otherwise(bare)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def _lines() -> Column:
    return F.split(text_or_empty("_text"), "\n", -1)


def common_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``h1, h2, keeper`` of the keys that many documents (columns _id, _text) hold; keeper is the largest _id."""
    keys = F.array_distinct(F.filter(F.transform(_lines(), line_key), lambda k: F.char_length(k) >= least_chars))
    held = docs.select("_id", F.explode(keys).alias("key")).select("_id", *_hashes(F.col("key")))
    counts = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keeper"))
    return counts.where(F.col("n") >= least_docs).select("h1", "h2", "keeper")


def dropped_positions(docs: DataFrame, common: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``_id, _mark, _drops``: the sorted positions (from 0) of the lines to drop, of documents that have any.

    ``_mark`` is a hash of the text: rows that share a doc_id (null ones, say) stay apart.
    """
    placed = docs.select("_id", F.xxhash64("_text").alias("_mark"), F.posexplode(_lines()).alias("pos", "line"))
    keyed = placed.select("_id", "_mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    hashed = keyed.select("_id", "_mark", "pos", *_hashes(F.col("key")))
    lost = hashed.join(common, ["h1", "h2"]).where(~F.col("_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("_id", "_mark").agg(F.array_sort(F.collect_set("pos")).alias("_drops"))


def _kept_lines() -> Column:
    """The lines between dropped positions: one slice for each gap, so the work is linear."""
    size, gaps = "size(_lines)", "size(_drops) + 1"
    start = "if(i = 0, 0, _drops[i - 1] + 1)"
    end = f"if(i = size(_drops), {size}, _drops[i])"
    return F.expr(f"flatten(transform(sequence(0, {gaps} - 1), i -> slice(_lines, {start} + 1, {end} - {start})))")


def without_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with ``text`` less its common lines, ``n_lines`` (before) and ``n_dropped``.

    A text that loses no line stays as it is, null included.
    """
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    narrow = held.select("_id", "_text")
    common = stored(common_keys(narrow, least_chars, least_docs), "common-lines")
    drops = stored(dropped_positions(narrow, common, least_chars), "dropped-lines")
    marked = held.withColumn("_mark", F.xxhash64("_text"))
    other = drops.select(F.col("_id").alias("_i"), F.col("_mark").alias("_m"), "_drops")
    met = marked.join(other, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m")), "left")
    split = met.select("_row", "_text", "_drops", _lines().alias("_lines"))
    text = F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(F.array_join(_kept_lines(), "\n"))
    added = {
        "text": text,
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
    }
    columns = {c: F.col("_row")[c] for c in docs.columns} | added
    return split.select(*[v.alias(c) for c, v in columns.items()])

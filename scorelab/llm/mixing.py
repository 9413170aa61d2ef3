"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. A document's virtual
finish time is the source's words up to and including it, divided by the
source's target, so at virtual time 1 every source has been served exactly its
target. A source may be passed through up to three times; pass k adds k times
the source's size before the division. Sorting all passes of all documents by
finish time interleaves the sources in proportion at every point.

The mix is what the total budget (the sum of the targets) reaches in that order:
all passes are range-sorted by finish time, words are summed over the range
partitions, and the sum is cut at the budget. A pass in service at virtual time
1 is two packets there, the words served by then and the rest, so the cut never
gives one source the words of another. Inside a source the order is that of its
passes, so what the cut leaves of a source is one number, its words served, and
every row's share follows from its place.

Running totals never put a source into one task: sums per (source, hash chunk)
give offsets, and the ordered sum runs inside a chunk only. The global sort holds
sizes and times only, no texts.

Rows: null text has size 0; null doc_id and null source are ordinary values
(null source sorts last); repeated rows are documents of their own, equal rows
are interchangeable. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.llm.common import WORD, stored, text_or_empty
from scorelab.operators.ordering import prefix_sums
from scorelab.session import checked_broadcast

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is passed through at most so many times.
MAX_REPEATS = 3


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Targets per source: shares of the total by weight, stopping at three times the source's size.

    ``sources`` has one row per source (source, source_size). Resharing the
    excess until no source is above its cap ends at target = least(cap, level *
    weight); the level is read off running sums in the order of cap / weight.
    The windows run over sources, not rows.
    """
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(cycle, (place % len(WEIGHTS) + 1).cast("int"))).withColumn(
        "cap", F.lit(MAX_REPEATS) * F.col("source_size")
    )
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level.cast("double")).withColumn(
        "level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    )
    return levelled.select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def schedule(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, the source's words before it and its finish time.

    ``docs`` needs ``doc_id``, ``source`` and ``size``; other columns pass through, unless they have one of
    the added names: those are replaced.
    """
    shuffled = docs.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(
        "_chunk", F.substring("_key", 1, 3)
    )
    chunks = stored(shuffled.groupBy("source", "_chunk").agg(F.sum("size").alias("_words")), "mix-chunks")
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("source", "_chunk", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    targets = source_targets(chunks.groupBy("source").agg(F.sum("_words").alias("source_size"))).drop("weight")
    known = offsets.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("_chunk").alias("_c"), "_offset", "source_size", "target"
    )
    inside = (
        Window.partitionBy("source", "_chunk").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = shuffled.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = placed.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return both.withColumn("before", F.col("_inside") + F.col("_offset")).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    ).drop("_key", "_chunk", "_inside", "_offset", "_s", "_c")


def packets(scheduled: DataFrame) -> DataFrame:
    """``source, words, finish`` of all passes of all rows; a pass in service at virtual time 1 is cut in two there.

    Rows without words have no packet.
    """
    begin = [F.lit(k) * F.col("source_size") + F.col("before") for k in range(MAX_REPEATS)]
    early = [F.greatest(F.lit(0), F.least(F.floor("target") - b, F.col("size"))).cast("long") for b in begin]
    both = [
        F.array(
            F.struct((b + e).alias("end"), e.alias("words")),
            F.struct((b + F.col("size")).alias("end"), (F.col("size") - e).alias("words")),
        )
        for b, e in zip(begin, early)
    ]
    cut = scheduled.where((F.col("size") > 0) & (F.col("target") > 0)).select("source", "target", F.explode(F.concat(*both)).alias("p"))
    return cut.where("p.words > 0").select("source", "p.end", "p.words", (F.col("p.end") / F.col("target")).alias("finish"))


def served_words(scheduled: DataFrame) -> DataFrame:
    """``_of, served``: the words of each source that the budget reaches in the order of finish times.

    The budget is the sum of the targets, each in whole words; sources from which it reaches nothing are absent.
    """
    budgets = scheduled.groupBy("source").agg(F.floor(F.max("target")).alias("whole")).agg(F.sum("whole").alias("budget"))
    budget = F.coalesce(stored(budgets, "mix-budget").scalar(), F.lit(0))
    ordered = prefix_sums(packets(scheduled), [], ["finish", "source", "end"], {"run": "words"})
    left = F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("run_before")))
    found = ordered.withColumn("left", left).where("left > 0").groupBy(F.col("source").alias("_of")).agg(F.sum("left").alias("served"))
    return checked_broadcast(found)


def with_served(scheduled: DataFrame, served: DataFrame) -> DataFrame:
    """Add ``served``, the words of the row's source that the mix takes."""
    met = scheduled.drop("served").join(served, F.col("source").eqNullSafe(F.col("_of")), "left")
    return met.withColumn("served", F.coalesce("served", F.lit(0))).drop("_of")


def taken_of_pass(k: int) -> Column:
    """Words of pass ``k`` of a row that the mix takes."""
    left = F.col("served") - F.lit(k) * F.col("source_size") - F.col("before")
    return F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")


def taken() -> Column:
    return sum((taken_of_pass(k) for k in range(1, MAX_REPEATS)), taken_of_pass(0))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, as whole documents in virtual time order; repeated documents are repeated rows.

    A pass that the budget cuts goes in when at least half of its words
    were served, so a source ends within half a document of its target.
    Documents without words are taken once: they cost nothing.
    """
    held = docs.select(F.struct("*").alias("_row"), "doc_id", "source", word_count().alias("size"))
    sizes = stored(schedule(held.drop("_row")), "mix-sizes")
    words = F.array(*[F.struct(F.lit(k).alias("pass"), taken_of_pass(k).alias("words")) for k in range(MAX_REPEATS)])
    passes = with_served(schedule(held), served_words(sizes)).withColumn("_p", F.explode(words)).where(
        F.when(F.col("size") == 0, F.col("_p.pass") == 0).otherwise(2 * F.col("_p.words") >= F.col("size"))
    )
    words = F.col("_p.pass") * F.col("source_size") + F.col("before") + F.col("size")
    time = F.coalesce(F.try_divide(words, F.col("target")), F.lit(0.0))
    ordered = passes.withColumn("_time", time)
    return ordered.repartitionByRange("_time", "doc_id").sortWithinPartitions("_time", "doc_id").select("_row.*")

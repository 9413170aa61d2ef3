"""Exact repeats of a fixed length, by bucket-pointer refinement over sampled suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere
else. Sorting every suffix would move every byte many times, so the suffixes are
bucketed in two stages.

1. Each start of a window belongs to an anchor: the leftmost smallest 16-gram
   among the ``SPAN`` grams that begin in the window's first bytes. It depends on
   the window's own bytes only, so equal windows have equal anchors at equal
   offsets. Initial buckets are the ``CORE``-grams at the anchors; every window of
   an anchor holds its core, so windows of different buckets differ.
2. An initial bucket with one anchor is done. In the others an anchor's context
   (all bytes of its windows) refines the bucket: anchors with equal contexts
   repeat as a whole. Only contexts that stand alone in a bucket with others need
   their bytes, and one context stands for all its equals. These are refined by
   bucket pointers: 25-grams first, then pairs of bucket identifiers (of an
   offset and of a later one) for 50, 100 and 200 bytes, each level reusing the
   identifiers of the one before.

Copies are collapsed before anything is shuffled: contexts that repeat inside a
batch are known at once and send one row for their bucket, so a passage that a
third of all documents hold sends a row per batch. Buckets with more than
``HOT`` different contexts send their windows' 128-bit hashes to an aggregate
instead of meeting in one task. Nothing is capped or dropped.

Rows are named by two 64-bit hashes of doc_id and text, so different rows do not share a name.

Null text is empty. Repeated rows are documents of their own and remove each
other; null doc_ids are ordinary values. Texts shorter than ``LENGTH`` keep all bytes. Matches never cross
documents; very long texts are scanned in stretches. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.llm.common import stored, text_or_empty, utf8

LENGTH, GRAM, SPAN = 200, 16, 92
#: Every window of an anchor holds so many bytes from the anchor on.
CORE = LENGTH - SPAN
#: Window starts scanned at once; different contexts of a bucket that meet in one task.
STRETCH, HOT = 1_000_000, 4096
#: Status bits of a run of window starts: repeats as a whole; its bytes are needed; it is judged by them.
WHOLE, SENT, JUDGED, CROWDED = 1, 2, 4, 8

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A ^ (y * _B + (y >> np.uint64(31)))
    z ^= z >> np.uint64(32)
    z *= _C
    return z ^ (z >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at every place."""
    words = np.array(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)))
    return _mix(words[:-8], words[8:])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: first start, last start, anchor, bucket and context hashes.

    ``data`` holds texts one after the other; windows lie inside ``[starts, ends)``.
    """
    grams = _grams(data)
    low = (grams >> np.uint64(24)) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
    for w in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-w], low[w:])
    low = np.minimum(low[: -(SPAN - 64)], low[SPAN - 64 :])
    edge = np.zeros(len(data) + 1, np.int8)
    fits = ends - starts >= LENGTH
    edge[starts[fits]] += 1
    edge[ends[fits] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge, dtype=np.int8))
    anchor = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    first, last, anchor = at[head], at[np.append(head[1:], len(at)) - 1], anchor[head]
    bucket = grams[anchor]
    for step in (*range(GRAM, CORE - GRAM, GRAM), CORE - GRAM):
        bucket = _mix(bucket, grams[anchor + step])
    stop = last + LENGTH - GRAM
    context = (anchor - first).astype(np.uint64) << np.uint64(16) | (last - first).astype(np.uint64)
    for step in range(0, LENGTH + SPAN, GRAM):
        context = _mix(context, grams[np.minimum(first + step, stop)])
    return first, last, anchor, bucket.view(np.int64), context.view(np.int64)


def _stretches(texts: list[bytes], limit: int = STRETCH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of about ``limit`` bytes; a stretch overlaps the next by a window less one."""
    group, held = [], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, limit):
            part = text[at : at + limit + LENGTH - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


ROWS = "k long, context long, rid long, rid2 long, at long, n int"


def _initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``ROWS``: ``n`` is 1 for a context met once in the batch, 2 for one row of a repeated context,
    and 0 for runs that are known to repeat (``at`` is the first start, ``context`` the number of starts)."""
    for batch in batches:
        texts = [utf8(t) for t in batch.column(2).to_pylist()]
        rid, rid2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        found = []
        for group in _stretches(texts):
            sizes = np.array([len(g[2]) for g in group])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            first, last, anchor, k, context = anchors(np.frombuffer(b"".join(g[2] for g in group), np.uint8), starts, ends)
            of = np.searchsorted(starts, first, side="right") - 1
            shift = np.array([g[1] for g in group])[of] - starts[of]
            owner = np.array([g[0] for g in group])[of]
            at = (first + shift) << 16 | (anchor - first) << 8 | (anchor - last)
            found.append((k, context, owner, at, last - first + 1))
        if not found:
            continue
        k, context, owner, at, count = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((context, k))
        same = np.zeros(len(order), bool)
        same[1:] = (k[order[1:]] == k[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
        group_no = np.cumsum(~same) - 1
        size = np.bincount(group_no)[group_no]
        lead = order[~same]
        n = np.where(size[~same] > 1, 2, 1)
        yield _rows(k[lead], context[lead], rid[owner[lead]], rid2[owner[lead]], at[lead], n)
        known = np.zeros(len(order), bool)
        known[order[size > 1]] = True
        places = np.flatnonzero(known)  # in text order: neighbouring runs become one
        if len(places):
            begin, of, many = at[places] >> 16, owner[places], count[places]
            fresh = np.ones(len(places), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (begin[1:] != begin[:-1] + many[:-1])
            heads = np.flatnonzero(fresh)
            total = np.add.reduceat(many, heads)
            yield _rows(rid[of[heads]], total, rid[of[heads]], rid2[of[heads]], begin[heads] << 16, np.zeros(len(heads)))


def _rows(k, context, rid, rid2, at, n) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (k, context, rid, rid2, at)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.asarray(n, np.int32))], ["k", "context", "rid", "rid2", "at", "n"])


def removed(n: int, runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans covered by runs of window starts (first, count), merged where they touch."""
    out: list[list[int]] = []
    for first, count in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + count - 1 + length)
        else:
            out.append([first, first + count - 1 + length])
    return [(a, min(b, n)) for a, b in out]


def digest(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Removed bytes, removed runs, sha256 of what is kept."""
    spans = removed(len(text), runs)
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return sum(b - a for a, b in spans), len(spans), kept.hexdigest()


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))
_MIXED = pa.schema([
    ("kind", pa.int32()), ("rid", pa.int64()), ("rid2", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("runs", _RUNS), ("k", pa.int64()),
    ("k2", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("judged", pa.bool_()), ("bytes", pa.binary()),
])
MIXED = (
    "kind int, rid long, rid2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, packed binary, "
    "runs array<struct<first:long,count:long>>, k long, k2 long, first long, count long, judged boolean, bytes binary"
)
DONE, OPEN, CONTEXT, WINDOW = range(4)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their runs: finished documents, documents that wait, and the bytes others wait for."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, held = [], 0
        for row in zip(*[batch.column(c) for c in ("rid", "rid2", "doc_id", "packed", "runs")], strict=True):
            rid, rid2, doc_id, packed, runs = (c.as_py() for c in row)
            name, runs = {"rid": rid, "rid2": rid2}, runs or []
            text = unzip.decompress(packed)
            whole = [(r["first"], r["count"]) for r in runs if r["status"] & WHOLE]
            base = name | {"doc_id": doc_id, "n_bytes": len(text)}
            if any(r["status"] & JUDGED for r in runs):
                merged = [{"first": a, "count": b - a - LENGTH + 1} for a, b in removed(len(text), whole)]
                rows.append(base | {"kind": OPEN, "packed": packed, "runs": merged})
            else:
                gone, spans, kept = digest(text, whole)
                rows.append(base | {"kind": DONE, "n_removed": gone, "n_spans": spans, "kept_sha256": kept})
            for r in runs:
                if not r["status"] & SENT:
                    continue
                first, count, judged = r["first"], r["count"], bool(r["status"] & JUDGED)
                if r["status"] & CROWDED:
                    for i in range(first, first + count):
                        both = np.frombuffer(xxhash.xxh3_128_digest(text[i : i + LENGTH]), np.int64).tolist()
                        rows.append(name | {"kind": WINDOW, "k": both[0], "k2": both[1], "first": i, "judged": judged})
                else:
                    part = text[first : first + count - 1 + LENGTH]
                    rows.append(name | {"kind": CONTEXT, "k": r["k"], "first": first, "count": count, "judged": judged, "bytes": part})
            held += len(packed)
            if held > 8_000_000 or len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, _MIXED)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _MIXED)


def _identifiers(pairs: np.ndarray) -> np.ndarray:
    """Bucket identifiers (dense, in sort order) of sort keys."""
    return np.unique(pairs, return_inverse=True)[1].astype(np.uint64)


def repeated_starts(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each text, which of its first ``counts`` window starts begin a window that begins elsewhere in ``texts`` too.

    Bucket-pointer refinement: identifiers of 25-grams, then of pairs of
    identifiers at an offset and 25, 50 and 100 bytes later.
    """
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    counts = np.array(counts)
    grams = _grams(np.frombuffer(b"".join(texts) + bytes(32), np.uint8))
    total = int(counts.sum())
    start = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)

    def needed(width: int) -> np.ndarray:
        flag = np.zeros(int(sizes.sum()) + 1, bool)
        for step in range(0, LENGTH, width):
            flag[start + step] = True
        return np.flatnonzero(flag)

    places = needed(25)
    bucket = np.zeros(int(sizes.sum()) + LENGTH, np.uint64)
    bucket[places] = _identifiers(_mix(grams[places], grams[places + 9]))
    for width in (25, 50, 100):
        places = needed(2 * width)
        finer = _identifiers(bucket[places] << np.uint64(32) | bucket[places + width])
        bucket = np.zeros_like(bucket)
        bucket[places] = finer
    names = bucket[start].astype(np.int64)
    again = np.bincount(names)[names] > 1
    return np.split(again, np.cumsum(counts)[:-1])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated window starts of judged contexts; the input is sorted by bucket, and buckets stay whole."""
    kept: list[tuple] = []

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[5] for r in rows], [r[3] for r in rows])
        out = []
        for (_, rid, first, _, judged, _, rid2), again in zip(rows, found, strict=True):
            if judged and again.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                out += [(rid, rid2, first + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "rid2", "first", "count"])

    for batch in batches:
        kept += zip(*[batch.column(c).to_pylist() for c in ("k", "rid", "first", "count", "judged", "bytes", "rid2")], strict=True)
        if len(kept) >= 8192:
            last, cut = kept[-1][0], len(kept)
            while cut and kept[cut - 1][0] == last:
                cut -= 1
            if cut:
                yield judge(kept[:cut])
                kept = kept[cut:]
    if kept:
        yield judge(kept)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for doc_id, packed, runs, more in zip(*[batch.column(c) for c in ("doc_id", "packed", "runs", "more")], strict=True):
            text = unzip.decompress(packed.as_py())
            own = [(r["first"], r["count"]) for r in [*(runs.as_py() or []), *(more.as_py() or [])]]
            out.append((doc_id.as_py(), len(text), *digest(text, own)))
        if out:
            types = [pa.int64()] * 4 + [pa.string()]
            columns = zip(zip(*out, strict=True), types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([press.compress(utf8(t)) for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["rid", "rid2", "doc_id", "packed"])


def runs_of_starts(named: DataFrame) -> DataFrame:
    """``rid, rid2, first, count, status, k`` of the runs of starts that repeat or may."""
    bucket, context = Window.partitionBy("k"), Window.partitionBy("k", "context")
    rows = (
        named.select("rid", "rid2", "text").mapInArrow(_initial, ROWS)
        .repartition("k")  # serves both windows
        .withColumns({"same": F.sum("n").over(context), "place": F.row_number().over(context.orderBy("rid", "rid2", "at"))})
        .withColumns({
            "all": F.sum("n").over(bucket),
            "alone": F.max(F.when((F.col("n") > 0) & (F.col("same") == 1), 1).otherwise(0)).over(bucket),
            "kinds": F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).over(bucket),
        })
    )
    judged = (F.col("same") == 1) & (F.col("all") > 1)
    sent = judged | ((F.col("alone") == 1) & (F.col("all") > 1) & (F.col("place") == 1))
    status = (
        F.when(F.col("same") > 1, WHOLE).otherwise(0) + F.when(sent, SENT).otherwise(0) + F.when(judged, JUDGED).otherwise(0)
        + F.when(F.col("kinds") > HOT, CROWDED).otherwise(0)
    )
    known = F.col("n") == 0
    return rows.where(known | (F.col("all") > 1)).select(
        "rid", "rid2", F.shiftright("at", 16).alias("first"),
        F.when(known, F.col("context")).otherwise(F.expr("(shiftright(at, 8) & 255) - (at & 255) + 1")).alias("count"),
        F.when(known, WHOLE).otherwise(status).alias("status"), "k",
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (doc_id, text)."""
    name = ["rid", "rid2"]
    text = text_or_empty()
    names = [F.xxhash64("doc_id", text).alias("rid"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("rid2")]
    named = docs.select(*names, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    runs = runs_of_starts(named).groupBy(*name).agg(F.collect_list(F.struct("first", "count", "status", "k")).alias("runs"))
    texts = named.mapInArrow(_packed, "rid long, rid2 long, doc_id long, packed binary")
    mixed = stored(texts.join(runs, name, "left").mapInArrow(_met, MIXED), "repeats")

    contexts = mixed.where(F.col("kind") == CONTEXT).select("k", *name, "first", "count", "judged", "bytes")
    found = contexts.repartition("k").sortWithinPartitions("k").mapInArrow(_refined, "rid long, rid2 long, first long, count long")
    windows = mixed.where(F.col("kind") == WINDOW).select("k", "k2", *name, "first", "judged")
    again = windows.groupBy("k", "k2").agg(F.count("*").alias("n")).where("n > 1")
    crowded = windows.where("judged").join(again, ["k", "k2"]).select(*name, "first", F.lit(1).cast("long").alias("count"))
    more = found.union(crowded).groupBy(*name).agg(F.collect_list(F.struct("first", "count")).alias("more"))

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    waiting = mixed.where(F.col("kind") == OPEN).select(*name, "doc_id", "packed", "runs").join(more, name, "left")
    done = mixed.where(F.col("kind") == DONE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.union(waiting.mapInArrow(_closed, result))

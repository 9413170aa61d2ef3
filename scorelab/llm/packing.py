"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised, closed with an end id and cut into pieces of at most
one sequence. Only the histogram of piece lengths (at most ``size`` bins) comes
to the driver. Lengths are placed longest first; each goes to the pattern of
packs with the most room left, whose count is split as needed. A pattern then
holds, for each length, an interval of ranks, and pieces find their pack by
(length, rank).

Ranks never put a length into one task: rows are numbered inside
(length, hash chunk) and chunk counts give offsets.

Null text is empty: one piece that holds the end id. Repeated rows are documents
of their own. Very long texts give as many pieces as they need.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.llm.common import stored

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Stems whose ids a worker remembers (below 100 MB).
STEMS = 200_000
BREAK = "<|endoftext|>"


#: Marks that are cut off words, and the bytes of ASCII letters and digits.
MARKS = ".,;:!?"
PLAIN = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Memory(dict):
    """Remembers at least the last ``most`` keys used: when it is full, keys that are not met again are let go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def unknown(self, keys: set) -> set:
        return keys.difference(self).difference(self.old)

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokeniser never joins characters across ASCII blanks
    and drops them, so the ids of a text are those of its words in order. The
    vocabulary lower-cases, and letters and punctuation are separate pre-tokens,
    so a word with one mark behind it is a stem and that mark. Stems not met
    before go to the library together, with a special token between them; what
    holds a special token's text goes alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.stop = self.library.token_to_id(BREAK)
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.stems = Memory(STEMS)
        self.marks = np.zeros(256, np.uint32)  # the one id of each mark
        for mark in MARKS:
            ids = self.library.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1 and ids[0]:
                self.marks[ord(mark)] = ids[0]

    def learn(self, stems: list[bytes]) -> None:
        odd = [w for w in stems if b"<|" in w or w.endswith(b"<")]
        letters = [w for w in stems if w.isalpha()]  # one pre-token each, so blanks are enough between them
        plain = [w for w in stems if not (w.isalpha() or b"<|" in w or w.endswith(b"<"))]
        for w in odd:
            ids = self.library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids
            self.stems[w] = np.array(ids, "<u4").tobytes()
        for some, between in ((letters, b" "), (plain, BREAK.encode())):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                line = between.join(part).decode("utf-8", "replace")
                ids = np.array(self.library.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
                if some is letters:
                    ends = np.flatnonzero(self.closing[ids]) + 1
                    starts = np.append(0, ends[:-1])
                else:
                    cuts = np.flatnonzero(ids == self.stop)
                    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
                if len(starts) != len(part):
                    raise RuntimeError("the vocabulary did not keep the words apart")
                raw = ids.tobytes()
                self.stems.update({w: raw[4 * a : 4 * b] for w, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True)})

    def trimmed(self, words: pa.StringArray) -> np.ndarray:
        """True for words that end in one mark which the pre-tokeniser cuts off: it follows a letter or digit."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size, stop = np.diff(ends), ends[1:].astype(np.int64)
        if not len(raw):
            return np.zeros(len(words), bool)
        last, before, third = (raw[np.maximum(stop - k, 0)] for k in (1, 2, 3))
        beyond = (size > 2) & (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        return (size > 1) & (self.marks[last] > 0) & (PLAIN[before] | beyond)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end.

        Each distinct word is looked up once; what is new is learned at once.
        """
        self.stems.turn()
        # lower-casing A-Z first saves many words twice over; it must not turn text into a special token
        texts = pc.fill_null(texts, "")
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        words = split.flatten()
        trim = self.trimmed(words)
        coded = pc.dictionary_encode(pc.if_else(pa.array(trim), pc.utf8_slice_codeunits(words, 0, -1), words))
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(list(self.stems.unknown(set(distinct))))
        found = list(map(self.stems.__getitem__, distinct))
        table = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy(zero_copy_only=False)
        stems = sizes[word]
        upto = np.append(0, np.cumsum(stems + trim))
        ids = np.empty(upto[-1], "<u4")
        stem_at = np.ones(upto[-1], bool)
        if trim.any():
            marks = upto[1:][trim] - 1
            stem_at[marks] = False
            ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1]
            ids[marks] = self.marks[np.frombuffer(words.buffers()[2], np.uint8)[ends[trim] - 1]]
        skip = np.append(0, np.cumsum(stems))
        ids[stem_at] = table[np.repeat((np.cumsum(sizes) - sizes)[word] - skip[:-1], stems) + np.arange(skip[-1])]
        return ids, upto[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]


@cache
def word_ids(path: str) -> WordIds:
    """One memory per worker process; workers serve many tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, step: int = 1024) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document cut at multiples of ``size``.

    ``step`` documents are looked up together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                rows: list[tuple] = []
                ids, ends = words.of(some.column(1))
                raw_ids, ends = ids.tobytes(), (4 * ends).tolist()
                for doc_id, a, b in zip(some.column(0).to_pylist(), [0, *ends], ends, strict=False):
                    raw = raw_ids[a:b] + end
                    total = len(raw) // 4
                    for start in range(0, total, size):
                        part = raw[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
                columns = zip(*rows, strict=True)
                del ids, raw_ids
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def patterns(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, list[int]]]:
    """``(packs, lengths)`` such that the packs hold exactly the histogram's pieces.

    The open patterns are kept by room left; the shortest pack (most room) is
    filled first, one piece a pack. Each length adds at most one split and two new
    patterns, so their number is bounded by three times the number of lengths.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    full: list[tuple[int, list[int]]] = []

    def keep(packs: int, inside: list[int], left_over: int) -> None:
        if packs and left_over:
            room.setdefault(left_over, []).append((packs, inside))
        elif packs:
            full.append((packs, inside))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:  # nothing open has room: new packs, filled with this length
                each = size // length
                keep(left // each, [length] * each, size - each * length)
                keep(min(1, left % each), [length] * (left % each), size - (left % each) * length)
                break
            packs, inside = room[most].pop()
            if not room[most]:
                del room[most]
            used = min(packs, left)
            keep(packs - used, inside, most)
            keep(used, [*inside, length], most - length)
            left -= used
    return full + [p for kept in room.values() for p in kept]


def slots(found: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset`` sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, inside in found:
        offset = 0
        for length in inside:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + packs
            offset += length
        sequence += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(cut: DataFrame, chunks: int = 64) -> DataFrame:
    """Add ``rank`` (from 0) of each piece among those of its length."""
    keyed = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    counts = keyed.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = keyed.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "_chunk"]).withColumn("rank", F.col("rank") + F.col("_offset")).drop("_chunk", "_offset")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``."""
    cut = stored(pieces(docs, tokenizer, end_id, size), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(patterns(histogram, size))
    scale = max(1, sum(histogram.values()))
    at = table[:, 0] * scale + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("rank", "length"))
            slot = np.searchsorted(at, length * scale + rank, side="right") - 1
            names = PIECE.replace(" long", "").split(", ")
            columns = [batch.column(n) for n in names]
            columns += [pa.array(table[slot, 2] + rank - table[slot, 1]), pa.array(table[slot, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    chunks = max(64, sum(histogram.values()) // 1_000_000)
    return ranked(cut, chunks).mapInArrow(place, PIECE + ", sequence_id long, offset long")

"""Phrase collocations by HAT-trie counting.

Each task numbers the words it meets and counts words, pairs and triples in a
shallow trie: the root holds one subtree per first word, a subtree is a hash
container of the remaining word ids, and a container that grows past ``BURST``
entries bursts into one container per second word. When the trie holds more than
``ENTRIES`` entries its largest subtrees are spilled whole. A spill is cut by
prefix partition (the first word and one of 64 hash slots of the rest, so that a
word which begins a third of all phrases still spreads) into runs, each sorted
and written with its own vocabulary; Spark's shuffle holds them. One task then
merges the runs of a prefix partition and keeps what occurs often enough.
Partitions are as many as the bytes of text ask for, so the entries of one are
bounded by ``PART_BYTES`` of text.

Everything is per language. Null text is empty, null language is ``und`` (and
shares its counts with a language of that name). Repeated rows count each time;
doc_ids are not looked at, so null ones count too. Very long texts are counted
in steps of a megabyte that hand over their last two words. An empty table gives
no rows. Ties are ordered by the phrase's bytes. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelab.llm.common import stored, text_or_empty
from scorelab.operators.ordering import numbered

#: Occurrences a phrase needs, the share (percent) of them inside one longer phrase that drops it, rows per language.
LEAST, ABSORBED, TOP = 10, 50, 2000
#: Entries of a container before it bursts, of a trie before it spills, and words a task numbers before it starts anew.
BURST, ENTRIES, WORDS = 16_384, 2_000_000, 1 << 20
#: Bytes of text counted at once, and bytes of text whose phrases one merge holds.
STEP, PART_BYTES = 4 << 20, 16 << 20
#: Buckets that a language's candidates are ranked in before their best meet.
RANK_BUCKETS = 256

BITS = 21
LOW, ONE = (1 << 2 * BITS) - 1, (1 << BITS) - 1
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TABLE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _LOWER + b"\n" * len(_BREAKS) + b" ")
_GAP = re.compile(rb"[ \n]")


class Numbers(dict):
    """Word -> id in order of appearance; 0 is the empty string, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Trie:
    """Counts by packed ids: first word, then the second and third (0: none)."""

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}
        self.parted: set[int] = set()
        self.burst, self.entries = burst, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are sorted and distinct."""
        heads, rests, ns = keys >> 2 * BITS, (keys & LOW).tolist(), counts.tolist()
        cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(keys)]
        for head, a, b in zip(heads[cuts[:-1]].tolist(), cuts, cuts[1:]):
            box = self.root.get(head)
            if box is None:
                self.root[head] = dict(zip(rests[a:b], ns[a:b]))
                new = b - a
            elif head in self.parted:
                new = 0
                for rest, n in zip(rests[a:b], ns[a:b]):
                    child = box.setdefault(rest >> BITS, {})
                    new -= len(child)
                    child[rest & ONE] = child.get(rest & ONE, 0) + n
                    new += len(child)
            else:
                new = -len(box)
                for rest, n in zip(rests[a:b], ns[a:b]):
                    box[rest] = box.get(rest, 0) + n
                new += len(box)
            self.entries += new
            size = self.sizes[head] = self.sizes.get(head, 0) + new
            if size > self.burst and head not in self.parted:
                self._part(head)

    def _part(self, head: int) -> None:
        children: dict[int, dict] = {}
        for rest, n in self.root[head].items():
            children.setdefault(rest >> BITS, {})[rest & ONE] = n
        self.root[head] = children
        self.parted.add(head)

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Remove the largest subtrees, whole, until ``keep`` entries are left: their keys and counts."""
        heads, lengths, rests, ns = [], [], [], []
        for head in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            box, size = self.root.pop(head), self.sizes.pop(head)
            if head in self.parted:
                self.parted.discard(head)
                for second, child in box.items():
                    rests.append([second << BITS | third for third in child])
                    ns.append(child.values())
            else:
                rests.append(box.keys())
                ns.append(box.values())
            heads.append(head)
            lengths.append(size)
            self.entries -= size
        total = sum(lengths)
        keys = np.repeat(np.array(heads, np.int64) << 2 * BITS, lengths) | np.fromiter(chain.from_iterable(rests), np.int64, total)
        return keys, np.fromiter(chain.from_iterable(ns), np.int64, total)


def _planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: the high ones, all zero, compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: memoryview, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def prefix_part(first: np.ndarray, second: np.ndarray, third: np.ndarray, lang: str, parts: int) -> np.ndarray:
    """Partition of a phrase from its words' hashes (0: none): the first word and a slot of the rest."""
    slot = _mixed(_mixed(second) + third) >> np.uint64(58)
    return (_mixed(_mixed(first ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) + slot) % np.uint64(parts)).astype(np.int64)


def sorted_runs(words: list[bytes], keys: np.ndarray, counts: np.ndarray, lang: str, parts: int) -> Iterator[tuple[int, bytes]]:
    """The spilled subtrees as one sorted run per prefix partition."""
    ids = [keys >> 2 * BITS, keys >> BITS & ONE, keys & ONE]
    used = np.zeros(len(words), bool)
    for column in ids:
        used[column] = True
    used[0] = False
    known = np.flatnonzero(used)
    chosen = pa.array([words[i] for i in known.tolist()], pa.binary())
    order = pc.sort_indices(chosen).to_numpy()
    chosen = np.array(chosen.take(pa.array(order)).to_pylist(), object)
    rank, digest = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
    rank[known[order]] = np.arange(1, len(known) + 1)
    digest[known[order]] = np.fromiter(map(xxhash.xxh64_intdigest, chosen), np.uint64, len(chosen))
    part = prefix_part(*[digest[column] for column in ids], lang, parts)
    ids = [rank[column] for column in ids]
    by = np.lexsort((ids[0] << 2 * BITS | ids[1] << BITS | ids[2], part))
    part, counts, ids = part[by], counts[by], [column[by].astype(np.int32) for column in ids]
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    place = np.zeros(len(known) + 1, np.int32)
    for a, b in zip(cuts, cuts[1:]):
        own = [column[a:b] for column in ids]
        seen = np.zeros(len(known) + 1, bool)
        for column in own:
            seen[column] = True
        seen[0] = False
        here = np.flatnonzero(seen)
        place[here] = np.arange(1, len(here) + 1)
        vocabulary = b" ".join(chosen[here - 1].tolist())
        head = np.array([b - a, len(vocabulary)], np.int64).tobytes()
        yield int(part[a]), head + vocabulary + b"".join(_planes(place[column]) for column in own) + _planes(counts[a:b])


class Counter:
    """One task's tries, by language."""

    def __init__(self, parts: int, entries: int = ENTRIES, words: int = WORDS, step: int = STEP, burst: int = BURST):
        self.parts, self.entries, self.words, self.step, self.burst = parts, entries, words, step, burst
        self.numbers, self.tries = Numbers(), {}

    def feed(self, lang: str, raw: bytes) -> Iterator[tuple[int, str, bytes]]:
        """Count a translated text; runs come out whenever the tries are full."""
        at, tail = 0, np.zeros(0, np.int64)
        while at < len(raw):
            cut = _GAP.search(raw, at + self.step)
            to = cut.end() if cut else len(raw)
            words = raw[at:to].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            a = np.concatenate([tail, ids[ids != 0]])
            self._count(lang, a, len(tail))
            at, tail = to, a[-2:]
            if len(self.numbers) > self.words:
                names = list(self.numbers)
                kept = [names[i] for i in tail.tolist()]
                yield from self.flush()
                tail = np.array([self.numbers[w] for w in kept], np.int64)
            elif sum(t.entries for t in self.tries.values()) > self.entries:
                yield from self._spilled(4)

    def _count(self, lang: str, a: np.ndarray, old: int) -> None:
        """Phrases that end behind the first ``old`` words."""
        word = a > 1
        two = word[1:] & word[:-1]
        three = two[1:] & two[:-1]
        keys = [a[old:][word[old:]] << 2 * BITS]
        skip = max(old - 1, 0)
        keys.append((a[:-1] << 2 * BITS | a[1:] << BITS)[skip:][two[skip:]])
        skip = max(old - 2, 0)
        keys.append((a[:-2] << 2 * BITS | a[1:-1] << BITS | a[2:])[skip:][three[skip:]])
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        if len(found):
            self.tries.setdefault(lang, Trie(self.burst)).add(found, counts)

    def _spilled(self, share: int) -> Iterator[tuple[int, str, bytes]]:
        words = list(self.numbers)
        for lang, trie in self.tries.items():
            keys, counts = trie.spill(trie.entries // share if share else 0)
            if len(keys):
                for part, run in sorted_runs(words, keys, counts, lang, self.parts):
                    yield part, lang, run

    def flush(self) -> Iterator[tuple[int, str, bytes]]:
        yield from self._spilled(0)
        self.numbers, self.tries = Numbers(), {}


class Merge:
    """Runs of one prefix partition and language, merged; sums are formed whenever many entries wait."""

    def __init__(self, waiting: int = 4_000_000):
        self.numbers: dict[bytes, int] = Numbers()
        self.keys: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.waits, self.most, self.waiting = 0, waiting, waiting

    def add(self, run: bytes) -> None:
        n, size = np.frombuffer(run, np.int64, 2).tolist()
        words = [b"", *run[16 : 16 + size].split(b" ")]
        names = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        data = memoryview(run)[16 + size :]
        self.keys.append([names[_unplaned(data[4 * n * i : 4 * n * (i + 1)], np.int32, n)].astype(np.int32) for i in range(3)])
        self.counts.append(_unplaned(data[12 * n :], np.int64, n))
        self.waits += n
        if self.waits > self.most:
            self._sum()
            self.most = self.waits + self.waiting

    def _sum(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.keys)]
        counts = np.concatenate(self.counts)
        if len(self.numbers) <= ONE:
            first, second, third = (c.astype(np.int64) for c in columns)
            order = np.argsort(first << 2 * BITS | second << BITS | third)
        else:
            order = np.lexsort(columns[::-1])
        columns, counts = [c[order] for c in columns], counts[order]
        new = np.ones(len(counts), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.flatnonzero(new)
        self.keys, self.counts = [[c[starts] for c in columns]], [np.add.reduceat(counts, starts)]
        self.waits = len(starts)

    def frequent(self, least: int) -> Iterator[tuple[str, int, int]]:
        """(phrase, words, n) of all with at least ``least``; words 0 is the number of word occurrences."""
        self._sum()
        columns, counts = self.keys[0], self.counts[0]
        yield "", 0, int(counts[columns[1] == 0].sum())
        kept = np.flatnonzero(counts >= least)
        names = list(self.numbers)
        for *ids, n in zip(*[c[kept].tolist() for c in columns], counts[kept].tolist()):
            parts = [names[i] for i in ids if i]
            yield b" ".join(parts).decode("utf-8", "surrogatepass"), len(parts), n


def _batches(rows: Iterator[tuple], schema: pa.Schema, step: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= step:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


RUNS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("run", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def phrase_counts(docs: DataFrame, least: int = LEAST, **limits: int) -> DataFrame:
    """``lang, phrase, words, n``: all words, pairs and triples that occur ``least`` times or more, and rows
    with 0 words whose sum is a language's number of word occurrences. ``limits`` are those of ``Counter``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(parts, **limits)

        def rows() -> Iterator[tuple]:
            waiting: dict[str, list[bytes]] = {}
            held = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    for lang, text in zip(some.column("lang").to_pylist(), some.column("text").cast(pa.binary()).to_pylist()):
                        waiting.setdefault(lang, []).append(text)
                        held += len(text)
                    if held >= counter.step:  # a larger piece repeats more of its phrases
                        for lang, own in waiting.items():
                            yield from counter.feed(lang, b"\n".join(own).translate(TABLE) + b"\n")
                        waiting, held = {}, 0
                        pa.default_memory_pool().release_unused()
            for lang, own in waiting.items():
                yield from counter.feed(lang, b"\n".join(own).translate(TABLE) + b"\n")
            yield from counter.flush()

        yield from _batches(rows(), RUNS, 8)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges: dict[str, Merge] = {}
        for batch in batches:
            for lang, run in zip(batch.column("lang").to_pylist(), batch.column("run")):
                merges.setdefault(lang, Merge()).add(run.as_py())

        def rows() -> Iterator[tuple]:
            while merges:
                lang, merged = merges.popitem()
                for phrase, words, n in merged.frequent(least):
                    yield lang, phrase, words, n

        yield from _batches(rows(), COUNTS, 10_000)

    runs = texts.mapInArrow(count, "part int, lang string, run binary")
    return runs.repartitionById(parts, F.col("part")).mapInArrow(merge, "lang string, phrase string, words int, n long")


def _cuts() -> Column:
    def cut(k: int) -> Column:
        first = F.substring_index("phrase", " ", k)
        return F.struct(F.lit(k).alias("k"), first.alias("first"), F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)").alias("rest"))

    return F.explode(F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2))))


def collocations(docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, **limits: int) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` needs ``lang`` and ``text``. A phrase of two or three words that occurs ``a`` times is scored by its
    weakest cut: floor(1000000 a a / (l r)), where l and r count its parts. A pair of which ``absorbed`` percent
    lie inside one frequent triple is dropped.
    """
    counts = stored(phrase_counts(docs, least, **limits), "phrases")
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("of"))
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    longer = found.where("words = 3").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = found.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True))
    )
    cut = alone.select("lang", "phrase", "a", _cuts().alias("cut")).select("lang", "phrase", "a", "cut.*")
    left = cut.join(known.select("lang", F.col("part").alias("first"), F.col("of").alias("l")), ["lang", "first"])
    both = left.join(known.select("lang", F.col("part").alias("rest"), F.col("of").alias("r")), ["lang", "rest"])
    wide = {c: f"cast({c} as decimal(18,0))" for c in "alr"}
    score = F.expr(f"(cast({wide['a']} * {wide['a']} as decimal(31,0)) * 1000000BD) div ({wide['l']} * {wide['r']})")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    scored = weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    # a phrase among the best of its language is among the best of its bucket; the rest are numbered by range partitions
    best = scored.withColumns({"_bucket": F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)), "_s": -F.col("score"), "_a": -F.col("a")})
    inside = Window.partitionBy("lang", "_bucket").orderBy("_s", "_a", "phrase")
    best = best.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top)
    best = numbered(best.drop("rank", "_bucket"), ["lang"], ["_s", "_a", "phrase"], "rank").where(F.col("rank") <= top)
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

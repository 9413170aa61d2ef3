"""Token counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens are held as one flat array of symbols with the
start of each sequence. In every round each sequence finds its lowest-rank
adjacent pair and applies all its occurrences at once, left to right; sequences
without a pair leave, and their surviving symbols are counted.

Merging one occurrence can create a pair of lower rank than the one being
merged. One-at-a-time merging would then turn to that pair first, so a sequence
where this happens applies only its leftmost occurrence in that round. The
result equals one-at-a-time merging always.

Pre-tokens: no piece of the vocabulary has a space mark after another
character, so nothing merges across the start of a run of spaces; nothing merges
across a line feed either when no piece holds one. Both are read from the
vocabulary when it is loaded. Characters outside the vocabulary count one token
for each UTF-8 byte.

Null text is empty and has no tokens. A very long pre-token is one sequence like
any other; a round costs its length, and there are as many rounds as ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import utf8

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000


class PieceCounter:
    """Counts tokens as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
        scores = {p: model.get_score(i) for p, i in pieces.items()}
        self.prefix = SPACE if model.encode("a", out_type=str)[0].startswith(SPACE) else ""
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("this vocabulary merges across spaces")
        self.symbols = pieces
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        merges = {}
        for p, i in pieces.items():
            for at in range(1, len(p)):
                left, right = pieces.get(p[:at]), pieces.get(p[at:])
                if left is not None and right is not None:
                    merges[(left << 32) | right] = (order[scores[p]], i)
        keys = sorted(merges)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([merges[k][0] for k in keys], np.int32)
        self.made = np.array([merges[k][1] for k in keys], np.int32)
        alone = not any("\n" in p and len(p) > 1 for p in pieces)
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, int] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` if none) and merged symbol of adjacent symbols."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NEVER), self.made[at]

    def merge(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each non-empty pre-token."""
        get = self.symbols.get
        flat = np.array([get(c, -len(c.encode("utf-8", "surrogatepass"))) for t in texts for c in t], np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        names, counts = np.arange(len(texts)), np.zeros(len(texts), np.int64)

        def ranks(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
            rank[:-1], made[:-1] = self.pairs(symbols[:-1], symbols[1:])
            rank[np.cumsum(sizes) - 1] = NEVER
            return rank, made

        rank, made = ranks(flat, sizes)
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            live = least < NEVER
            if not live.all():
                done = ~live
                cost = np.where(flat < 0, -flat, 1)  # an unknown character is its bytes
                counts[names[done]] = np.add.reduceat(cost, starts)[done]
                stay = np.repeat(live, sizes)
                flat, rank, made = flat[stay], rank[stay], made[stay]
                names, sizes, least = names[live], sizes[live], least[live]
                if not len(sizes):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hits = np.flatnonzero(rank == least[owner])
            fresh = np.ones(len(hits), bool)
            fresh[1:] = hits[1:] != hits[:-1] + 1
            run = np.flatnonzero(fresh)
            place = np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))
            hits = hits[place % 2 == 0]  # overlapping occurrences: every other one
            now = self.apply(flat, rank, made, sizes, owner, hits)
            early = self.overtaken(now, least, hits, owner)
            if len(early):
                first = np.ones(len(hits), bool)
                first[1:] = owner[hits[1:]] != owner[hits[:-1]]
                hits = hits[first | ~np.isin(owner[hits], early)]
                now = self.apply(flat, rank, made, sizes, owner, hits)
            flat, rank, made, sizes, _ = now
        return counts

    def apply(self, flat, rank, made, sizes, owner, hits):
        """Merge at ``hits``; only pairs that touch a merged symbol are looked up again."""
        symbols = flat.copy()
        symbols[hits] = made[hits]
        stay = np.ones(len(flat), bool)
        stay[hits + 1] = False
        symbols, rank, made = symbols[stay], rank[stay], made[stay]
        at = hits - np.arange(len(hits))
        sizes = sizes - np.bincount(owner[hits], minlength=len(sizes))
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(sizes) - 1] = True
        near = np.union1d(at, at[at > 0] - 1)
        rank[near] = NEVER
        near = near[~ends[near]]
        rank[near], made[near] = self.pairs(symbols[near], symbols[near + 1])
        return symbols, rank, made, sizes, near

    def overtaken(self, now, least, hits, owner) -> np.ndarray:
        """Sequences with several merges in which a new pair does not rank after the merged one."""
        _, rank, _, sizes, near = now
        several = np.bincount(owner[hits], minlength=len(sizes)) > 1
        if not several.any():
            return np.empty(0, np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)[near]
        return np.unique(of[(rank[near] <= least[of]) & several[of]])

    def count(self, texts: list[str | None]) -> list[int]:
        split, prefix = self.split, self.prefix
        parts = [split(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*parts).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set().union(*parts)
        new = list(fresh)
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.known.update(zip(some, self.merge(some).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, p)) for p in parts]


@cache
def piece_counter(path: str) -> PieceCounter:
    """One memory per worker process; workers serve many tasks."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, step: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``step`` documents are merged together."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column(1).to_pylist()
                tokens = np.array(counter.count(texts), np.int64)
                sizes = pa.array([len(utf8(t)) for t in texts], pa.int64())
                columns = [part.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)]
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, schema)

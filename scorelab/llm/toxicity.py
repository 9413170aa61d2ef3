"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. In each clause the words become classes - insult,
threat, target, negation, report, intent, other - and transducers run over them
one after the other: negation turns an insult it governs into a negated one,
reported speech into a quoted one, and the clause transducer gives a weight to
the matched pattern (direct insult, threat against a target, bare insult ...).
Weights are log-odds and add up over the clauses; a logistic curve turns their
sum and its density in the text into a probability.

The function words of the grammar are fixed lists in four languages. Insults are
learned: whole words and word stems whose document frequency among toxic and
clean training texts differs beyond chance, given how many were looked at. Training takes at most ``TRAINING_ROWS``
labelled texts of each class (those with the smallest hash); texts that share
their smallest shingle hash are one text there, so copies of one toxic document
do not make its words insults. Held-out rows (crc32 of the doc_id as text, mod
3, is 1) are never learned from, and labels, language, source and id are no
inputs of a score.

Null and empty texts have no evidence and score lowest. Rows without label, or
with conflicting labels (any toxic one wins), are handled; without training rows
of both classes no insult is known and only the fixed threats raise a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import in_slices, stored

#: Labelled training texts of each class at most; the fit's only bound.
TRAINING_ROWS = {1: 2000, 0: 4000}
#: Stems have so many letters at least and at most; a longer word counts as a whole.
STEM = (3, 10)
#: A word or stem must occur in so many toxic training texts, be so many times likelier there (log), and its
#: log-likelihood ratio must pass that of the luckiest of all units looked at by so much.
SUPPORT, EVIDENCE, MARGIN = 3, 1.5, 2.0
THRESHOLD = 0.7

# Function words of the grammar: fixed values, plain and in order.
TARGETS = """you your yours yourself he she they him her them his their du dich dir dein deine deiner ihr euch euer er sie
tu toi ton ta tes vous votre vos il elle ils tú te ti tu tus usted ustedes él ella ellos vosotros""".split()
NEGATIONS = "not no never nor isn aren wasn don doesn nicht kein keine keiner nie niemals ne pas jamais aucun aucune no nunca jamás ningún ninguna".split()
REPORTS = """said says say called calls wrote writes quoted quotes reported claimed allegedly sagte sagt nannte nennt schrieb
zitierte angeblich dit disait appelle appelé écrit cité prétend dijo dice llamó llama escribió citó supuestamente""".split()
INTENTS = "will gonna going shall must should werde wirst werden muss vais vas va allons dois voy vas vamos debes debe".split()
THREATS = """kill hurt destroy beat shoot stab burn strangle murder umbringen töten schlagen erschießen verbrennen vernichten
tuer frapper détruire brûler abattre étrangler matar golpear destruir quemar disparar apuñalar""".split()

CLAUSE_END = re.compile(r"[.!?;:\n|]")
WORDS = re.compile(r"[^\W\d_]+").findall


class Transducer:
    """Weighted finite-state transducer, deterministic: ``arcs[state, symbol] = (output, weight, state)``.

    Symbols without an arc are copied with no weight and leave the state as
    ``stay`` says: kept, or back to the start.
    """

    def __init__(self, arcs: dict, stay: bool, final: dict | None = None):
        self.arcs, self.stay, self.final = arcs, stay, final or {}

    def run(self, symbols: Iterable[str]) -> tuple[list[str], float]:
        state, weight, out = 0, 0.0, []
        for s in symbols:
            made, w, state = self.arcs.get((state, s), (s, 0.0, state if self.stay else 0))
            weight += w
            if made:
                out.append(made)
        return out, weight + self.final.get(state, 0.0)


def compose(transducers: Sequence[Transducer], symbols: Sequence[str]) -> tuple[list[str], float]:
    """Output and total weight of running each transducer on what the one before wrote."""
    total, now = 0.0, list(symbols)
    for t in transducers:
        now, w = t.run(now)
        total += w
    return now, total


# I insult, H threat, T target, N negation, R report, M intent, o other; i a negated insult, q a quoted one
#: An insult is negated when at most two other words stand between it and the negation.
NEGATED = Transducer(
    {(0, "N"): ("N", 0.0, 1)}
    | {(s, "N"): ("N", 0.0, 1) for s in (1, 2, 3)}
    | {(s, o): (o, 0.0, s + 1) for s in (1, 2) for o in "oTMR"}
    | {(s, "I"): ("i", -4.0, 0) for s in (1, 2, 3)}
    | {(s, "H"): ("o", 0.0, 0) for s in (1, 2, 3)},
    stay=False,
)
#: What follows a report in the same clause is somebody else's.
REPORTED = Transducer({(0, "R"): ("R", 0.0, 1), (1, "I"): ("q", -2.0, 1), (1, "H"): ("o", 0.0, 1)}, stay=True)
#: Patterns of a clause: a target before or after an insult, a threat with intent or target.
PATTERN = Transducer(
    {
        (0, "T"): ("", 0.0, 1), (0, "I"): ("insult", 0.0, 2), (0, "M"): ("", 0.0, 3), (0, "H"): ("", 0.0, 4),
        (1, "I"): ("direct", 1.0, 2), (1, "M"): ("", 0.0, 3), (1, "H"): ("", 0.0, 4),
        (2, "T"): ("direct", 1.0, 1), (2, "I"): ("insult", 0.0, 2), (2, "M"): ("", 0.0, 3), (2, "H"): ("threat", 2.5, 2),
        (3, "H"): ("", 0.5, 4), (3, "T"): ("", 0.0, 3), (3, "I"): ("direct", 1.0, 2),
        (4, "T"): ("threat", 1.5, 1), (4, "I"): ("threat", 2.5, 2),
    },
    stay=True,
)
GRAMMAR = (NEGATED, REPORTED, PATTERN)


class Grammar:
    """The lexical transducer (learned insults, fixed function words) in front of the clause grammar.

    ``lexicon`` maps a stem, or a whole word followed by ``$``, to its log-odds.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.fixed = {w: s for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", INTENTS), ("H", THREATS)) for w in words}
        self.trigger = ahocorasick.Automaton()
        for w in [*lexicon, *(f"{h}$" for h in THREATS)]:
            self.trigger.add_word(w.removesuffix("$"), len(w.removesuffix("$")))
        self.trigger.make_automaton()

    def insult(self, word: str) -> float:
        """Weight of the longest known stem of the word, or of the word itself; 0 if neither is known."""
        known = self.lexicon.get(word + "$", 0.0)
        for n in range(min(len(word), STEM[1]), STEM[0] - 1, -1):
            if n <= len(word) and (w := self.lexicon.get(word[:n], 0.0)):
                return max(w, known)
        return known

    def symbols(self, clause: str) -> tuple[list[str], float]:
        out, weight = [], 0.0
        for word in WORDS(clause):
            w = self.insult(word)
            weight += w
            out.append("I" if w else self.fixed.get(word, "o"))
        return out, weight

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of the clauses in which a trigger occurs."""
        done = -1
        for end, size in self.trigger.iter(text):
            at = end - size + 1
            if at <= done or (at and (text[at - 1].isalpha())):
                continue
            start = done + 1
            for m in CLAUSE_END.finditer(text, done + 1, at):
                start = m.end()
            stop = CLAUSE_END.search(text, end + 1)
            stop = stop.start() if stop else len(text)
            yield start, stop
            done = stop

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed weight and number of the matched clauses."""
        low = (text or "").lower()
        total, matched = 0.0, 0
        if low and len(self.trigger):
            for a, b in self.clauses(low):
                symbols, lexical = self.symbols(low[a:b])
                found, weight = compose(GRAMMAR, symbols)
                if any(x in ("insult", "direct", "threat", "i", "q") for x in found):
                    total += max(0.0, lexical + weight)
                    matched += 1
        return total, matched

    def features(self, text: str | None) -> list[float]:
        total, matched = self.evidence(text)
        words = 1 + (text or "").count(" ")
        return [math.log1p(total), math.log1p(100.0 * total / (words + 50.0)), math.log1p(matched)]


@dataclass(frozen=True)
class Model:
    """Learned lexicon and the logistic curve over ``Grammar.features``."""

    lexicon: tuple[tuple[str, float], ...] = ()
    curve: tuple[float, ...] = (math.log(0.1 / 0.9), 0.5, 0.0, 0.0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features.reshape(-1, 3) @ np.array(self.curve[1:]) + self.curve[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fitted_curve(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps."""
    mid, wide = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - mid) / wide])
    beta, penalty = np.zeros(4), np.diag([0.0, ridge, ridge, ridge])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (toxic - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4), slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / wide
    return (float(beta[0] - slopes @ mid), *map(float, slopes))


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _units(words: set[str]) -> set[str]:
    low, high = STEM
    return {w[:n] for w in words for n in range(low, min(len(w), high) + 1)} | {w + "$" for w in words}


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic`` of the training rows taken, and how many rows of each class there are."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    chosen = None
    for kind, most in TRAINING_ROWS.items():
        one = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = one if chosen is None else chosen.union(one)
    # at most sum(TRAINING_ROWS) rows of two numbers
    ids = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))
    return docs.join(ids, F.col("doc_id") == F.col("_id")).select("text", "toxic"), sizes


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and curve from the labelled rows outside the held-out third."""
    texts, sizes = training_texts(docs, labels)

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 50):  # a text has thousands of units
                some, made = frame.iloc[at : at + 50], []
                for text, toxic in zip(some["text"], some["toxic"], strict=True):
                    words = WORDS((text or "").lower())
                    line = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
                    made.append((min(map(xxhash.xxh64_intdigest, line)) - 2**63, int(toxic), text, sorted(_units(set(words)))))
                yield pd.DataFrame(made, columns=["same", "toxic", "text", "units"])

    per_text = texts.mapInPandas(units, "same long, toxic int, text string, units array<string>")
    once = stored(per_text.groupBy("same").agg(F.max(F.struct("toxic", "units", "text")).alias("t")).select("t.*"), "toxic-units")
    taken = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not taken.get(1) or not taken.get(0):
        return Model()
    counts = stored(
        once.select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
        ).where((F.col("bad") > 1) | (F.col("good") > 1)),
        "toxic-counts",
    )
    share = taken[1] / (taken[0] + taken[1])
    n = F.col("bad") + F.col("good")
    ratio = F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (taken[1] + 1.0)) - F.log((F.col("good") + 0.5) / (taken[0] + 1.0))
    bar = math.log(max(2, counts.count())) + MARGIN
    strong = counts.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).where((F.col("odds") >= EVIDENCE) & (ratio >= bar))
    # the texts are bounded by TRAINING_ROWS, so are the units that several toxic ones share
    found = {r["unit"]: r["odds"] for r in strong.select("unit", "odds").collect()}
    lexicon = tuple(sorted(minimal(found).items()))
    rows = once.select("toxic", _features(lexicon)(F.col("text")).alias("f")).collect()
    toxic = np.array([r["toxic"] for r in rows], float)
    weight = np.where(toxic == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    return Model(lexicon, fitted_curve(np.array([r["f"] for r in rows]), toxic, weight * len(rows) / weight.sum()))


def minimal(found: dict[str, float]) -> dict[str, float]:
    """Leave out what a known, at least as strong, shorter stem already covers."""
    kept: dict[str, float] = {}
    for unit in sorted(found, key=lambda u: (len(u.removesuffix("$")), u)):
        word = unit.removesuffix("$")
        if not any(kept.get(word[:n], -1.0) >= found[unit] for n in range(STEM[0], min(len(word), STEM[1]) + 1)):
            kept[unit] = found[unit]
    return kept


@lru_cache(maxsize=2)
def _grammar(lexicon: tuple[tuple[str, float], ...]) -> Grammar:
    return Grammar(dict(lexicon))


def _features(lexicon: tuple[tuple[str, float], ...]):
    def run(texts: pa.Array) -> pa.Array:
        g = _grammar(lexicon)
        return pa.array([g.features(t) for some in in_slices(texts) for t in some], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``_score``, the probability of label 1."""

    def run(texts: pa.Array) -> pa.Array:
        g = _grammar(model.lexicon)
        return pa.array(model.scores(np.array([g.features(t) for some in in_slices(texts) for t in some], float)))

    return docs.withColumn("_score", F.arrow_udf(run, "double")(F.col("text")))

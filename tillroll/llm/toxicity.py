"""Toxicity by a weighted finite-state grammar over clauses.

Words have classes: insult, threat, target, negation, reported speech, other. Four small transducers
follow a clause: the negation one is open for some words after a negation, the report one until the
clause ends, the target one near a word of address, and the attack one emits at every insult or
threat. Their product is one table; what an insult adds to depends on the joint state. An insult or
threat without a target before it waits for one behind it, over as many words. Scores are a
logistic function of what the matched clauses add up to.

Insults are learned as whole words or word beginnings that a bounded sample of labelled texts has
in toxic texts only; the other classes are fixed words of four languages.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillroll.llm.common import Batches, batch_of, labelled_sample, packed, small_batches

# Words of each class, lower case.
INSULTS = ("idiot moron stupid imbecile scumbag asshole bastard bitch dumbass retard cretin dimwit halfwit jackass "
           "dickhead douchebag wanker twat slut whore | dummkopf vollidiot arschloch trottel depp wichser hurensohn "
           "schlampe missgeburt | idiota imbécil estúpido estúpida gilipollas cabrón pendejo puta | "
           "idiote imbécile connard connasse salope abruti crétin").replace("|", "").split()
THREATS = ("kill murder strangle shoot stab hurt beat destroy | töten umbringen erschießen | "
           "matar matarte golpear | tuer frapper égorger").replace("|", "").split()
TARGETS = ("you your you're he she they them him her | du dich dir ihr euch sie | tú te ti usted ustedes él ella | "
           "tu toi vous il elle ils").replace("|", "").split()
NEGATIONS = ("not no never isn't aren't don't wasn't nobody | nicht kein keine nie niemals | no nunca jamás | "
             "ne pas jamais").replace("|", "").split()
REPORTS = ("said says called calls quoted wrote reported claims | sagte sagt nannte schrieb | dijo dice llamó | "
           "dit disait écrit").replace("|", "").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
KINDS = ("plain", "aimed", "denied", "reported", "threat")  # what an attack counts as
UNDECIDED = len(KINDS)  # a threat that only a target behind it confirms
REACH = 4            # words over which negation and address carry
SAMPLE = 4_000       # toxic texts a grammar is fitted on at most; twice as many others
PRIOR = np.array([-3.0, 3.0, 4.0, 1.0, 1.0, 3.0])  # bias and weight of each kind before any label is seen

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.;:!?\n]")


# --- transducers ---------------------------------------------------------------------------

def _countdown(trigger: int):
    """Open for REACH words after the trigger."""
    def step(state: int, symbol: int) -> int:
        return REACH if symbol == trigger else max(0, state - 1)

    return step, range(REACH + 1)


def _latch(trigger: int):
    """Open from the trigger to the end of the clause."""
    return (lambda state, symbol: int(state or symbol == trigger)), range(2)


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers: next state and emitted kind (-1: none) by state and symbol."""
    parts = [_countdown(NEGATION), _latch(REPORT), _countdown(TARGET)]
    states = list(itertools.product(*(s for _, s in parts)))
    number = {s: k for k, s in enumerate(states)}
    after = np.zeros((len(states), 6), np.int64)
    kind = np.full((len(states), 6), -1, np.int64)
    for k, state in enumerate(states):
        denied, reported, near = state
        for symbol in range(6):
            after[k, symbol] = number[tuple(step(s, symbol) for (step, _), s in zip(parts, state))]
            if symbol in (INSULT, THREAT):
                kind[k, symbol] = (
                    2 if denied else 3 if reported else 1 if near and symbol == INSULT
                    else 4 if near else 0 if symbol == INSULT else UNDECIDED)
    return after, kind


_AFTER, _KIND = compose()


@dataclass
class Grammar:
    """Insult patterns with their strength (a trailing $ marks a whole word) and fitted weights."""

    insults: dict[str, float]
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.classes = {w: c for c, words in (
            (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}
        self.starts = sorted({len(p) for p in self.insults if not p.endswith("$")})
        self.finder = ahocorasick.Automaton()
        for p in [*(i.rstrip("$") for i in self.insults), *THREATS]:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()

    def strength(self, word: str) -> float:
        """0 if the word is no insult."""
        own = self.insults.get(word + "$", 0.0)
        return max([own, *(self.insults.get(word[:n], 0.0) for n in self.starts if n <= len(word))])

    def clause(self, text: str) -> np.ndarray:
        """What one clause adds to each kind."""
        found = np.zeros(len(KINDS))
        state = 0
        words = _WORD.findall(text)
        strengths = [self.strength(w) for w in words]
        symbols = [INSULT if s else self.classes.get(w, OTHER) for w, s in zip(words, strengths)]
        for k, symbol in enumerate(symbols):
            kind = int(_KIND[state, symbol])
            if kind in (0, UNDECIDED):  # the address may also follow
                follows = TARGET in symbols[k + 1:k + 1 + REACH]
                kind = (1 if follows else 0) if kind == 0 else 4 if follows else -1
            if kind >= 0:
                found[kind] += strengths[k] or 1.0
            state = int(_AFTER[state, symbol])
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Clause sums of a whole text; only clauses with an insult or threat are parsed."""
        total = np.zeros(len(KINDS))
        if not text:
            return total
        text = text.lower()
        done, begin, ends = -1, 0, _CLAUSE_END.finditer(text)
        mark = next(ends, None)
        for end, length in self.finder.iter(text):
            start = end - length + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            while mark and mark.start() < start:  # every mark is passed once, however many words are found
                begin, mark = mark.end(), next(ends, None)
            done = mark.start() if mark else len(text)
            total += self.clause(text[begin:done])
        return total

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(features) @ self.weights[1:] + self.weights[0])))


# --- learning ------------------------------------------------------------------------------

def _patterns(text: str | None) -> set[str]:
    """Whole words and word beginnings of a text."""
    out = set()
    for word in set(_WORD.findall((text or "").lower())):
        out.add(word + "$")
        out.update(word[:n] for n in range(3, min(9, len(word))))
    return out


def _count_rows(batches: Batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pattern", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (toxic if label else clean).update(_patterns(text))
        names = list(toxic.keys() | clean.keys())
        yield batch_of(schema, names, [toxic[n] for n in names], [clean[n] for n in names])


def _has_rows(names: dict[str, int]):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("has", pa.list_(pa.int32()))])
        for batch in batches:
            yield batch_of(schema, [[names[p] for p in _patterns(t) if p in names]
                                    for t in batch.column("text").to_pylist()])

    return run


def _least(toxic: int) -> int:
    """Toxic texts a pattern has to explain by itself; fewer may be chance."""
    return max(3, toxic // 1000) if toxic > 30 else 2


def _cover(has: list[list[int]], names: list[str], counts: list[tuple[int, int]], cost: float) -> list[int]:
    """Patterns that explain the toxic texts: each the one that explains most of what is left.

    Chance words of copied texts are never chosen, as their texts are explained already. Common
    patterns that explain nothing new are insults too if they stand beside many different sets of
    chosen ones, which the chance words of a group of copies do not. What a pattern explains only
    shrinks, so a heap has the next best one; nothing is capped.
    """
    everywhere: dict[int, set[int]] = {}
    for row, found in enumerate(has):
        for p in found:
            everywhere.setdefault(p, set()).add(row)
    place = {p: k for k, p in enumerate(sorted(everywhere, key=lambda p: (len(names[p]), names[p])))}
    left = {p: set(rows) for p, rows in everywhere.items()}

    def worth(p: int) -> tuple[float, int, int]:
        return cost * counts[p][1] - len(left[p]), -place[p], p

    heap = [worth(p) for p in left]
    heapq.heapify(heap)
    chosen: list[int] = []
    while heap:
        known = heapq.heappop(heap)
        best = known[2]
        if known != (now := worth(best)):
            heapq.heappush(heap, now)
            continue
        gain = set(left[best])
        if len(gain) < _least(len(has)) or len(gain) <= cost * counts[best][1]:
            break
        chosen.append(best)
        for row in gain:
            for p in has[row]:
                left[p].discard(row)
    picked = set(chosen)
    beside = [frozenset(picked.intersection(found)) for found in has]
    for p in sorted(everywhere, key=lambda p: (-counts[p][0], -len(names[p]), names[p])):
        if len(everywhere[p]) < max(10, len(has) // 50):
            break
        stem = names[p].rstrip("$")
        if any(stem.startswith(names[c].rstrip("$")) or names[c].startswith(stem) for c in chosen):
            continue
        sets = Counter(beside[row] for row in everywhere[p])
        if sets.most_common(1)[0][1] <= len(everywhere[p]) // 2:
            chosen.append(p)
    return chosen


def _fit_weights(features: np.ndarray, labels: np.ndarray, counts: tuple[int, int] | None = None) -> np.ndarray:
    """Logistic weights, drawn towards the prior, by Newton steps.

    ``counts`` has how many (clean, toxic) texts the rows stand for; without it they stand for themselves.
    Labelled texts can lack what the grammar is for, so its order holds whatever they show: an insult
    weighs no less for being aimed at someone, and one clause that aims a strong insult or threat reaches
    one half.
    """
    x = np.column_stack([np.ones(len(features)), np.log1p(features)])
    toxic = labels > 0
    each = [n / max(1, int(mine.sum())) for n, mine in zip(counts, (~toxic, toxic))] if counts else (1.0, 1.0)
    share = np.where(toxic, each[1], each[0])
    share *= 200 / max(1.0, share.sum())
    w, pull = PRIOR.copy(), np.full(len(PRIOR), 0.05)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - labels)) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        far = np.abs(step).max()
        w -= step * min(1.0, 1.0 / max(far, 1e-12))  # a whole step may leap over the minimum
        if far < 1e-8:
            break
    plain, aimed, threat = (1 + KINDS.index(k) for k in ("plain", "aimed", "threat"))
    enough = -w[0] / np.log(2) + 1e-9
    w[aimed], w[threat] = max(w[aimed], w[plain], enough), max(w[threat], enough)
    return w


def _feature_rows(grammar: Grammar):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.features(t).tolist() for t in batch.column("text").to_pylist()]
            schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])
            yield batch_of(schema, batch.column("label").cast(pa.int32()), found)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Learn the insult list and the weights from at most ``sample`` toxic texts and twice as many others.

    The sample takes the ids with the smallest hashes, and of their texts each distinct one once, so
    repeated ids and rows do not make it larger. Weights count a text for as many as its label stands
    for among all labelled ids, so they do not depend on the size of the table. An id with two labels is
    toxic; rows without id or label are passed over. Without labelled toxic texts the fixed insults and
    the prior weights remain.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna() \
        .where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = labelled_sample(docs, known, {1: sample, 0: 2 * sample}, id_col, text_col)
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = {w + "$": 1.0 for w in INSULTS}
    if not toxic:
        return Grammar(base, PRIOR)
    cost = 20 * toxic / max(clean, toxic)  # a pattern must be 20 times as common in toxic texts
    found = texts.mapInArrow(_count_rows, "pattern string, toxic long, clean long").groupBy("pattern").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(
        (F.col("toxic") >= _least(toxic)) & F.expr(f"toxic > clean * {cost}")).orderBy("pattern").collect()
    names = [r["pattern"] for r in found]
    numbers = [(r["toxic"], r["clean"]) for r in found]
    has = texts.where("label = 1").orderBy("h").mapInArrow(
        _has_rows({n: k for k, n in enumerate(names)}), "has array<int>").collect()
    picked = _cover([r["has"] for r in has], names, numbers, cost)
    learned = {names[p]: float(np.clip(np.log((numbers[p][0] + 1) / toxic * clean / (numbers[p][1] + 1)) / 3, 0.5, 1.5))
               for p in picked}
    grammar = Grammar(base | learned, PRIOR)
    rows = texts.mapInArrow(_feature_rows(grammar), "label int, features array<double>").collect()
    grammar.weights = _fit_weights(
        np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], float),
        (counts.get(0, 0), counts.get(1, 0)))
    return grammar


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """(row, score) of every row: the whole text's score, 0 to 1. Null and empty texts score as clean."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((grammar.insults, grammar.weights))  # words of a bounded sample

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        mine = Grammar(*shared.value)
        for batch in batches:
            found = np.array([mine.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(KINDS))
            schema = pa.schema([("row", batch.column("row").type), ("score", pa.float64())])
            yield batch_of(schema, batch.column("row"), mine.scores(found))

    whole = packed(docs).select("row", F.col("row")[text_col].alias("text"))
    whole = whole.select(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col]).alias("row"),
                         "text")
    return whole.mapInArrow(run, T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns as they are."""
    return docs.where(~rejects(grammar, threshold)(F.col(text_col)))


def rejects(grammar: Grammar, threshold: float = 0.5):
    """A column function: whether a text is at or above the threshold."""
    insults, weights = grammar.insults, grammar.weights

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = Grammar(insults, weights)
        for texts in batches:
            found = np.array([mine.features(t) for t in texts]).reshape(-1, len(KINDS))
            yield pd.Series(mine.scores(found) >= threshold)

    return toxic


def training_rows(labels: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """The labelled rows a model may learn from: crc32 of the id's text not divisible by ``folds``."""
    return labels.where(~held_out(F.col(id_col), folds))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))

"""Toxicity by a weighted lexicon (operator 13).

Texts are folded: compatibility forms are replaced, marks that sit on or between letters go, look-alike letters of other
scripts and digits or signs used for letters become the Latin letter, case goes. Folded lexicon entries are found by one
Aho-Corasick pass. An entry is a whole word, or a stem (`idiot*`) that a tail of 1 to `TAIL` letters follows; a hit needs at
least one letter in what was written, so numbers are no words. Hits inside an exception phrase do not count, and of the hits
that begin at one place the heaviest counts. A text's evidence is the sum of its weights, normalised by its length; a
logistic curve over it gives the score.

Weights come from `SEED` and from at most `FIT_ROWS` labelled rows outside the held-out fold, those with the least hash of
the id; their texts are written once and counted by Spark. It counts the toxic texts that have a word or stem, keeps the
`CANDIDATES` most frequent ones (a bound on the model), and counts those in the texts of both labels. An entry's weight is the
lower confidence limit of its smoothed log odds; entries that chance may have made are left out. The curve is fitted on the
same rows, each scored with weights that its own third of them had no part in. No text reaches the driver.

Defined cases: a null text scores as an empty one; an empty text has no evidence and gets a score like any other; rows with
a null label are not learned from; without toxic or without clean training rows the seed's weights and a fixed curve are
used; repeated labels count as often as they occur; an empty table gives no rows; other columns are ignored. Words of over
`LONGEST` letters are no entries (they can still begin with a stem).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, fold, only

FIT_ROWS = 20_000
CANDIDATES = 20_000
TAIL = 6
STEMS = range(4, 10)
LONGEST = 40
#: A candidate occurs in at least this many toxic training texts.
LEAST = 3
#: Entries of less weight are left out, and those whose counts a chance would give more often than about once in 2,000.
LIGHT, DOUBT = 1.0, 12.0
FOLDS = 3
SEED_WEIGHT = 3.0

# General insults, and phrases in which such a word insults nobody.
SEED = (
    "asshole bastard bitch bullshit clown creep cretin crap cunt dickhead disgusting dumbass fool freak fuck garbage idiot "
    "imbecile jackass jerk loser moron motherfucker nasty pathetic pig prick retard scum shit slut stupid trash twat vermin "
    "whore worthless").split()
EXCEPTIONS = (
    "clown fish", "class clown", "fool proof", "garbage can", "garbage collection", "garbage collector", "guinea pig", "pig iron",
    "trash bin", "trash can", "taking out the trash", "sore loser")

# Characters that are used in place of Latin letters.
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}
#: Signs stand for a letter only inside a word, the dollar also at its start; "idiot!" ends in no letter.
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W_])|\$(?=[^\W\d_])")
_FOLD = str.maketrans(_LOOKALIKE)
_ODD = re.compile("[­Ā-\U0010ffff]")
#: Soft hyphens, combining marks that stay after composition, zero-width and direction marks.
_INSIDE = re.compile("[­̀-ͯ​-‏⁠-⁤︀-️﻿]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"\$?[^\W_]+(?:[@$!|€][^\W_]+)*")


def _lower(text: str | None) -> str:
    """Lower case without marks; look-alikes, digits and signs are left as they are."""
    text = (text or "").lower()
    return _INSIDE.sub("", unicodedata.normalize("NFKC", text)).lower() if _ODD.search(text) else text


def _latin(lower: str) -> str:
    """Look-alikes, digits and signs as the letters they are used for; the length stays."""
    return _SIGN.sub(lambda m: _SIGNS[m[0]], lower).translate(_FOLD)


def folded(text: str | None) -> str:
    """The text in folded form."""
    return _latin(_lower(text))


def entries_of(text: str | None) -> set[str]:
    """The entries that a text has: folded words that hold a letter, and stems of them."""
    out = set()
    for x in set(_WORD.findall(_lower(text))):
        if _LETTER.search(x):
            w = _latin(x)
            if w.isalpha():
                if len(w) <= LONGEST:
                    out.add(w)
                out.update(w[:n] + "*" for n in STEMS if n < len(w) <= n + TAIL)
    return out


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


@dataclass
class Lexicon:
    """Entries with their weights, and the curve. `curve` is over (1, evidence, density, heaviest, length)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.5, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            known: dict[str, tuple] = {}
            for entry, weight in self.weights.items():
                w = entry.rstrip("*")
                whole, stem, phrase = known.get(w, (0.0, 0.0, False))
                known[w] = (weight, stem, phrase) if w == entry else (whole, weight, phrase)
            for phrase in self.exceptions:
                w = folded(phrase)
                known[w] = (*known.get(w, (0.0, 0.0))[:2], True)
            built = ahocorasick.Automaton()
            for w, what in known.items():
                built.add_word(w, (len(w), *what))
            if known:
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the hits that count, in the folded text."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        written = _lower(text)
        flat = _latin(written)
        found, free = {}, []
        for last, (n, whole, stem, phrase) in automaton.iter(flat):
            start, end = last - n + 1, last + 1
            if start and flat[start - 1].isalpha():
                continue
            tail = 0
            while tail <= TAIL and end + tail < len(flat) and flat[end + tail].isalpha():
                tail += 1
            if phrase and not tail:
                free.append((start, end))
            weight = whole if not tail else stem if tail <= TAIL else 0.0
            if weight > found.get(start, (0, 0.0))[1]:
                if _LETTER.search(written, start, end + tail):
                    found[start] = (end + tail, weight)
        return [(a, b, w) for a, (b, w) in sorted(found.items()) if not any(x <= a and b <= y for x, y in free)]

    def evidence(self, text: str | None) -> tuple[float, float, float, float]:
        """Evidence, density, heaviest hit and length, as the curve takes them."""
        weights = [w for _, _, w in self.hits(text)]
        total, words = sum(weights), len((text or "").split())
        return math.log1p(total), total / math.sqrt(words + 10.0), max(weights, default=0.0), math.log1p(words)

    def score(self, text: str | None) -> float:
        return _logistic(self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.evidence(text))))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """t, y and third of the rows that are learned from, in a table of their own."""
    known = only(labels, [key, label]).where(F.col(label).isNotNull() & (fold(key, folds) != held_out))
    chosen = known.orderBy(F.xxhash64(key), key, label).limit(rows)
    third = F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("third")
    texts = chosen.join(only(docs, [key, text]), key).select(F.col(text).alias("t"), (F.col(label) > 0).cast("int").alias("y"), third)
    return Scratch(docs.sparkSession, "toxicity").keep(texts, "labelled")


def _counted(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """entry, y, third and n, the texts that have the entry; the entries of `among` only, if given. Counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            e, y, third = zip(*seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(e), pa.array(y, pa.int32()), pa.array(third, pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["entry", "y", "third", "n"])

        for batch in batches:
            for t, y, third in zip(*(batch.column(k).to_pylist() for k in range(3))):
                has = entries_of(t)
                seen.update((e, y, third) for e in (has if among is None else among.intersection(has)))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    part = rows.select("t", "y", "third").mapInArrow(count, "entry string, y int, third int, n bigint")
    return part.groupBy("entry", "y", "third").agg(F.sum("n").alias("n"))


def _weights(counts: dict[str, np.ndarray], totals: np.ndarray, seed: float = SEED_WEIGHT) -> dict[str, float]:
    """Lower limits of the log odds of toxic against clean, of entries where it is above `LIGHT` and
    the log-likelihood ratio above `DOUBT`. `counts` and `totals` are (clean, toxic).
    A seed word that no training text has keeps its prior weight."""
    out = {w: seed for w in SEED}
    if min(totals) == 0:
        return out
    for entry, (clean, toxic) in counts.items():
        if toxic < LEAST and not (entry in out and toxic + clean):
            continue
        odds = math.log((toxic + 0.5) / (totals[1] + 1)) - math.log((clean + 0.5) / (totals[0] + 1))
        share = totals[1] / sum(totals)
        gain = 2 * sum(n * math.log(n / ((clean + toxic) * p)) for n, p in ((clean, 1 - share), (toxic, share)) if n)
        limit = odds - 1.28 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if limit > LIGHT and gain > DOUBT:
            out[entry] = max(limit, seed) if entry in out and limit > seed / 2 else limit
        else:
            out.pop(entry, None)
    return out


def _newton(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 100) -> np.ndarray:
    """Logistic regression with a penalty on all but the first coefficient; a step is halved until the loss falls."""
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(b: np.ndarray) -> float:
        return float(np.sum(np.logaddexp(0, z @ b) - y * (z @ b)) + penalty @ (b * b) / 2)

    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (p - y) + penalty * b
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        size, now = 1.0, loss(b)
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return b


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """The curve over columns of like scale; evidence, density and heaviest hit never count against toxicity."""
    mean, scale, held = x.mean(axis=0), x.std(axis=0) + 1e-6, list(range(x.shape[1]))
    while True:
        b = _newton(np.column_stack([np.ones(len(y)), ((x - mean) / scale)[:, held]]), y, ridge)
        wrong = [h for h, c in zip(held, b[1:]) if h < 3 and c < 0]
        if not wrong:
            out = np.zeros(x.shape[1] + 1)
            for h, c in zip(held, b[1:]):
                out[1 + h] = c / scale[h]
            out[0] = b[0] - out[1:] @ mean
            return tuple(out.tolist())
        held.remove(wrong[0])


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
           folds: int = 4, held_out: int = 2, rows: int = FIT_ROWS, candidates: int = CANDIDATES) -> Lexicon:
    """The lexicon that the labelled rows outside the held-out fold give."""
    known = _labelled(docs, labels, key, text, label, folds, held_out, rows)
    totals = np.zeros((FOLDS, 2))
    for r in known.groupBy("third", "y").count().collect():
        totals[r["third"], r["y"]] = r["count"]
    if totals.sum(axis=0).min() == 0:
        return Lexicon({w: SEED_WEIGHT for w in SEED})
    toxic = _counted(known.where("y = 1"), None).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    top = toxic.orderBy(F.desc("n"), F.desc(F.length("entry")), "entry").limit(candidates)
    among = frozenset(r["entry"] for r in top.collect()) | frozenset(SEED)
    counts: dict[str, np.ndarray] = {}
    for r in _counted(known, among).collect():
        counts.setdefault(r["entry"], np.zeros((FOLDS, 2)))[r["third"], r["y"]] = r["n"]

    whole = Lexicon(_weights({e: c.sum(axis=0) for e, c in counts.items()}, totals.sum(axis=0)))
    without = [
        Lexicon(_weights({e: c.sum(axis=0) - c[k] for e, c in counts.items()}, totals.sum(axis=0) - totals[k])) for k in range(FOLDS)]

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series, third: pd.Series) -> pd.Series:
        return pd.Series([list(without[k].evidence(t)) for t, k in zip(texts, third)])

    got = known.select(evidence("t", "third").alias("x"), "y").collect()
    got.sort()  # sums in one order, however the rows were dealt out
    whole.curve = _curve(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float))
    return whole


def scorer(model: Lexicon, text: Column | str = "text") -> Column:
    """The probability of label 1, as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, score and predicted (1 if score >= threshold) of every document."""
    scored = only(docs, [key, text]).select(
        key, (fold(key, 4) == 2).alias("held_out"), scorer(fit_on(docs, labels, key, text), text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Quality classifier (operator 5): random-indexing vectors, pooled per document, and a two-layer network.

Every part of a text between white space gives two features: its word (letters, lower-cased) and its shape (the sequence
of its character classes, runs shortened). Parts of over `PART` characters, such as texts of languages without spaces, are
read as pieces: each run of letters, runs of over `PART` letters as their overlapping triples, and what is between them in
stretches of `PART`; every piece has its word and its shape. Both are hashed into `BUCKETS` places. A place has a fixed sparse ternary index
vector; its feature vector adds up the index vectors of the neighbours that the training texts show, scaled, plus its own.
A document is the mean of its vectors and the norms of these means, which are large where few words repeat. A network
with one hidden layer is fitted in numpy; a temperature fitted on rows set apart makes its outputs probabilities.

The model is fitted from at most `FIT_ROWS` labelled rows, chosen by a hash of the id; this bound is a parameter, and the
model's size is fixed. Texts stay in tasks: the driver gets sums of index vectors for each place and one pooled vector for
each row, so its memory does not follow the length of texts. Scoring reads every whole text and is independent of partitions and batches.

Defined cases: a null text scores as an empty one; an empty text has the zero vector and gets a score like any other;
rows with a null label are not learned from; of rows with a chosen id, the network sees `FIT_ROWS` at most; if the training rows lack one of the two labels, every score is the share
of label 1 (1.0 without any row); repeated labels count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, fold, only

FIT_ROWS = 3000
BUCKETS = 1 << 15
DIMS = 32
NONZERO = 4
HIDDEN = 24
REMEMBERED = 700_000
BLOCK = 100_000
PART = 24
GRAM = 3
SEED = 7

_WORD = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+", re.S)
_SPLIT = re.compile(r"[^\W\d_]+|[\W\d_]+")


def _classes() -> dict[int, str]:
    out = {}
    for c in range(0x250):
        x = chr(c)
        out[c] = "a" if x.islower() else "A" if x.isupper() else "9" if x.isdigit() else x
    return out


_CLASS = _classes()


def _word_and_shape(x: str) -> tuple[str, str]:
    core, tail = (x, "") if x.isalpha() else (x[:-1], x[-1])
    if core.isalpha():  # the usual part: letters, or letters and one more character
        if core.islower():
            return core, ("aa" if len(core) > 1 else "a") + tail.translate(_CLASS)
        if core[1:].islower():
            return core.lower(), ("Aaa" if len(core) > 2 else "Aa") + tail.translate(_CLASS)
    return "".join(_WORD.findall(x)).lower(), _RUNS.sub(r"\1\1", x.translate(_CLASS))


def _pieces(x: str) -> Iterator[str]:
    """What a long part is read as."""
    for m in _SPLIT.finditer(x):
        run = m[0]
        if len(run) <= PART:
            yield run
        elif run[0].isalpha():
            yield from (run[k : k + GRAM] for k in range(len(run) - GRAM + 1))
        else:
            yield from (run[k : k + PART] for k in range(0, len(run), PART))


def _parts(text: str) -> Iterator[str]:
    for x in text.split():
        if len(x) > PART:
            yield from _pieces(x)
        else:
            yield x


def _place(x: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(x, seed) % BUCKETS


class Features:
    """Places of the words and shapes of a text, as one number each: word place * BUCKETS + shape place."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        out = [np.zeros(0, np.int32)]
        every = _parts(text or "")
        while parts := list(islice(every, BLOCK)):
            if len(known) > REMEMBERED or len(self.shapes) > REMEMBERED:
                known.clear()
                self.shapes.clear()
            for x in set(parts).difference(known):
                word, shape = _word_and_shape(x)
                if shape not in self.shapes:
                    self.shapes[shape] = _place(shape, 1)
                known[x] = _place(word) * BUCKETS + self.shapes[shape]
            out.append(np.fromiter(map(known.__getitem__, parts), dtype=np.int32, count=len(parts)))
        both = np.concatenate(out)
        return both // BUCKETS, both % BUCKETS


_features = Features()


def index_vectors(seed: int) -> np.ndarray:
    """Sparse ternary vectors, NONZERO entries each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def add_contexts(total: np.ndarray, seq: np.ndarray, index: np.ndarray) -> None:
    """Adds to each place the index vectors of its neighbours up to two steps away. These are whole numbers: sums are exact."""
    for k in range(0, len(seq), BLOCK):
        part = seq[k : k + BLOCK]
        near = np.zeros((len(part), DIMS), np.float32)
        for step in (1, 2):
            near[step:] += index[part[:-step]]
            near[:-step] += index[part[step:]]
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        total[held] += np.add.reduceat(near[order], first, axis=0)


def context_vectors(total: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A place's neighbours, scaled to length 1, plus half its own index vector."""
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.maximum(length, 1e-12) + 0.5 * index).astype(np.float32)


@dataclass
class Model:
    vectors: tuple[np.ndarray, np.ndarray] | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    share: float = 1.0

    def pooled(self, text: str | None) -> np.ndarray:
        out = []
        for places, vectors in zip(_features.places(text), self.vectors):
            total = np.zeros(DIMS)
            for k in range(0, len(places), BLOCK):
                total += vectors[places[k : k + BLOCK]].sum(axis=0, dtype=np.float64)
            mean = total / max(len(places), 1)
            distinct = len(np.unique(places)) / max(len(places), 1)
            out += [mean, [np.linalg.norm(mean), distinct, np.log1p(len(places))]]
        return np.concatenate(out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, text: str | None) -> float:
        if self.vectors is None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.logits(self.pooled(text)) / self.temperature, -50, 50))))


def _train(x: np.ndarray, y: np.ndarray, seed: int, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Adam on the mean log loss of tanh-then-logistic, all rows at each step."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y) / len(y)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], e.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def context_sums(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour sums of word places and of shape places."""
    totals = np.zeros((BUCKETS, DIMS)), np.zeros((BUCKETS, DIMS))
    index = index_vectors(SEED), index_vectors(SEED + 1)
    for text in texts:
        for total, places, vectors in zip(totals, _features.places(text), index):
            add_contexts(total, places, vectors)
    return totals


def untrained(totals: tuple[np.ndarray, np.ndarray]) -> Model:
    return Model((context_vectors(totals[0], index_vectors(SEED)), context_vectors(totals[1], index_vectors(SEED + 1))))


def trained(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Network and temperature from pooled rows."""
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - model.mean) / model.scale
    apart = np.arange(len(y)) % 5 == 0  # rows come in the order of a hash
    model.layers = _train(z[~apart], y[~apart], SEED)
    out = model.logits(x[apart])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
    model.temperature = float(grid[np.argmin([_log_loss(out / t, y[apart]) for t in grid])])
    return model


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of texts at hand, as `fit_on` makes it of a table."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, share=float(y.mean()) if len(y) else 1.0)
    model = untrained(context_sums(iter(texts)))
    return trained(model, np.array([model.pooled(t) for t in texts]), y)


_SUMS = [f"d{k}" for k in range(DIMS)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's neighbour sums: (side, place, one column a dimension)."""
    totals = context_sums(t.as_py() for batch in batches for t in batch.column(0))
    for side, total in enumerate(totals):
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held), side, np.int32)), pa.array(held.astype(np.int32)), *(pa.array(c) for c in total[held].T.copy())],
            names=["side", "place", *_SUMS])


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           folds: int = 4, held_out: int = 2, rows: int = FIT_ROWS) -> Model:
    """Learns from at most `rows` labelled rows outside the held-out fold: those with the least hash of the key."""
    known = only(labels, [key, label]).where(F.col(label).isNotNull() & (fold(key, folds) != held_out))
    chosen = known.orderBy(F.xxhash64(key), key, label).limit(rows)
    scratch = Scratch(docs.sparkSession, "quality")
    taught = scratch.keep(chosen.join(only(docs, [key, text]), key).select(
        F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"), F.col(label).cast("int").alias("y")), "taught")
    least, most, share = taught.agg(F.min("y"), F.max("y"), F.avg("y")).first()
    if least == most:
        scratch.drop("taught")
        return Model(None, share=1.0 if share is None else share)
    # At most BUCKETS rows for words and for shapes, whatever the texts.
    sums = taught.select("text").mapInArrow(_summed, "side int, place int, " + ", ".join(f"{c} double" for c in _SUMS))
    held = sums.groupBy("side", "place").agg(*(F.sum(c).alias(c) for c in _SUMS)).toArrow()
    side, place, *columns = (held.column(c).to_numpy() for c in ("side", "place", *_SUMS))
    totals = np.zeros((2, BUCKETS, DIMS))
    totals[side, place] = np.stack(columns, axis=1)
    model = untrained((totals[0], totals[1]))

    @F.pandas_udf("array<double>")
    def pool(texts: pd.Series) -> pd.Series:
        return pd.Series([model.pooled(t) for t in texts], dtype=object)

    order = ["h", "k", "y", "t"]
    got = taught.select(*order, pool("text").alias("x")).orderBy(*order).limit(rows).collect()
    scratch.drop("taught")
    return trained(model, np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float))


def scorer(model: Model, text: Column | str = "text") -> Column:
    """The probability of label 1, as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, score and predicted (1 if score >= threshold) of every document."""
    scored = only(docs, [key, text]).select(
        key, (fold(key, 4) == 2).alias("held_out"), scorer(fit_on(docs, labels, key, text), text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

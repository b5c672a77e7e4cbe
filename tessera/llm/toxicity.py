"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are sets of hashed indices: words, word stems (the first 4, 5 and
6 letters, so that an unseen ending still counts), pairs of neighbours and pairs one
word apart; what stands there 2, 4 or 8 times or more has an index of its own for
each of those levels.  Training takes one labelled row at a time with per-coordinate rates and
an L1 penalty, which leaves few weights; those are broadcast (at most ``2**bits``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, pieces, sampled_ids, ship

BITS = 20
MEMO = 200_000
STEMS = (4, 5, 6)
LEVELS = (1, 2, 4, 8)
#: Indices in one row of a training set, so that an Arrow batch of any sets stays small (10,000 rows: 10 MB).
CHUNK = 256
_WORD = re.compile(r"\w+")
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Features:
    """Hashed n-grams of a text; remembers the words that it has met, within a bound."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)

    def _learn(self, words: set[str]) -> None:
        """Hash new words: the whole word, then its stems (0 where it is too short)."""
        first = len(self.known)
        if first + len(words) > len(self.table):
            grown = np.zeros((2 * (first + len(words)), self.table.shape[1]), np.uint64)
            grown[:first] = self.table[:first]
            self.table = grown
        digest = xxhash.xxh64_intdigest
        for i, w in enumerate(words, first):
            self.known[w] = i
            size = len(w)
            self.table[i] = (digest(w, 1), *[digest(w[:n], 100 + n) if size >= n else 0 for n in STEMS])

    def __call__(self, text: str) -> np.ndarray:
        """Indices, repeats included; 0 stands for no feature."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > MEMO:
            self.known.clear()
        try:
            at = list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.known))
            at = list(map(self.known.__getitem__, words))
        h = self.table[at]
        u = h[:, 0]
        near, far = u[:-1] * _NEXT + u[1:], u[:-2] * _SKIP + u[2:]
        return np.concatenate([h.ravel(), near * _NEXT, far * _SKIP]) >> self.shift


def at_level(at: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The indices of features that stand ``level`` times or more: a permutation of all indices for each level."""
    return (at if level == 1 else at * (0x9E3779B1 + 2 * level) + level) & ((1 << bits) - 1)


def feature_set(at: np.ndarray, bits: int) -> np.ndarray:
    """The distinct indices of a text over all levels, from its indices with repeats."""
    found, n = np.unique(at.astype(np.int64), return_counts=True)
    return np.unique(np.concatenate([at_level(found[n >= x], x, bits) for x in LEVELS]))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss over sets of indices."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label)
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))


_SHARED: dict[int, Features] = {}


def features(bits: int) -> Features:
    """One per worker process."""
    return _SHARED.setdefault(bits, Features(bits))


MODEL = T.StructType([T.StructField("at", T.LongType()), T.StructField("weight", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 12000, bits: int = BITS, epochs: int = 4, modulus: int = 3, held: int = 1) -> dict[int, float]:
    """Weights by index, the bias at -1, from at most ``sample`` labelled rows.

    Rows with crc32(doc_id) mod ``modulus`` equal to ``held`` are never read for
    training; the sample is the ``sample`` rows with the smallest hash of the id.
    Null ids, labels that are null, and texts that are null do not train.  An id trains
    once: of repeated rows the smallest text counts, of labels that differ the larger.  One task
    trains: its input is bounded by ``sample``.  No labelled row gives no weights.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    part = crc_mod("doc_id", modulus)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(part != held).groupBy("doc_id").agg(F.max("toxic").alias("__label"))
    chosen = sampled_ids(chosen, sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "__label").agg(F.min("text").alias("text")).select("doc_id", "text", "__label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import Ftrl

        found: dict = {}
        for b in batches:
            values, ends = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            for k, (i, y, c) in enumerate(zip(*(b.column(n).to_pylist() for n in range(3)), strict=True)):
                found.setdefault((i, int(y)), []).append((c, values[ends[k] : ends[k + 1]]))
        order = sorted(found, key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[0]))
        for chunks in found.values():
            chunks.sort(key=lambda c: c[0])
        model = Ftrl(bits)
        for _ in range(epochs):
            for row in order:  # put together when it is its turn: the batches are held once
                model.learn(np.concatenate([a for _, a in found[row]]), row[1])
        if order:
            at = np.flatnonzero(np.abs(model.z) > model.l1)
            w = model.weights(at)
            at, w = at[w != 0], w[w != 0]
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w.tolist(), model.bias], pa.float64())], names=["at", "weight"])

    sets = training_sets(rows, bits)
    return {r["at"]: r["weight"] for r in sets.repartition(1).mapInArrow(fit, MODEL).collect()}


def training_sets(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, __label, chunk, at): the feature set of each row of (doc_id, text, __label), ``CHUNK`` indices a row; an empty set is one empty row."""
    import pyarrow as pa

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import CHUNK, feature_set, features

        made = features(bits)
        for b in pieces(batches):
            sets = [feature_set(made(x.as_py()), bits).astype(np.int32) for x in b.column(1)]
            chunks = [max(1, -(-len(s) // CHUNK)) for s in sets]
            row = np.repeat(np.arange(len(sets)), chunks)
            chunk = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in chunks]])
            sizes = [min(CHUNK, len(sets[r]) - CHUNK * c) for r, c in zip(row.tolist(), chunk.tolist(), strict=True)]
            ends = np.cumsum([0, *sizes], dtype=np.int32)
            at = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(chunk, pa.int32()), at], names=["doc_id", "__label", "chunk", "at"])

    return rows.mapInArrow(hashed, "doc_id long, __label int, chunk int, at array<int>")


def score(docs: DataFrame, weights: dict[int, float], *, bits: int = BITS, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``name``: the chance of label 1, from the whole text.

    A null or empty text scores by the bias alone; no model at all scores 0.0.
    A column of ``docs`` already called ``name`` is replaced.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    docs = docs.drop(name)
    bias = weights.get(-1)
    at = np.array(sorted(k for k in weights if k >= 0), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()]), bias))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import LEVELS, at_level, features

        at, values, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[at] = values
        every = np.arange(1 << bits)
        tables = np.stack([dense[at_level(every, x, bits)] for x in LEVELS])  # weights by base index, level by level
        used = (tables != 0).any(0)
        made = features(bits)
        for b in pieces(batches):
            out = []
            for x in b.column(column):
                total = bias or 0.0
                if s := x.as_py():
                    idx = made(s)
                    hit, n = np.unique(idx[used[idx]], return_counts=True)
                    total += sum(t[hit[n >= x]].sum() for t, x in zip(tables, LEVELS, strict=True))
                out.append(0.0 if bias is None else float(1 / (1 + np.exp(-np.clip(total, -35, 35)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **how: int) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= ``threshold``).

    Nulls, empty texts, repeated rows and empty tables: see :func:`train` and
    :func:`score`; a null doc_id is scored and is not held out.
    """
    weights = train(docs, labels, **how)
    scored = score(docs.select("doc_id", "text"), weights, bits=how.get("bits", BITS))
    held = crc_mod("doc_id", how.get("modulus", 3)) == how.get("held", 1)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **how: int) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; same columns."""
    weights = train(docs, labels, **how)
    scored = score(docs, weights, bits=how.get("bits", BITS), name="__score")
    return scored.where(F.col("__score") < threshold).drop("__score")

"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins.  Boosting cycles over the features,
fits a shallow tree over one feature's bins to the current residuals and adds it to
that feature's lookup table; then the pairs of features that explain most of what is
left get two-way tables in the same manner.  A score adds one table entry for each
feature and pair, for a whole batch at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, pieces, sampled_ids, ship

NAMES = ("log_words", "word_length", "distinct_words", "top_word", "same_as_last", "symbols", "symbol_ends", "capitals", "digits", "bars", "stops", "repeated_lines", "line_words", "repeated_pairs")
_SYMBOL_END = re.compile(r"[^\w\s.,;:?'\")\]-](?:\s|$)")
_SYMBOLS = "$%&#*!@^~_=+<>{}\\/`"


def describe(text: str) -> list[float]:
    """The features of one whole text, in the order of ``NAMES``."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    capitals = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        (size - text.count(" ")) / n,
        len(counts) / n**0.85,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(text.count, _SYMBOLS)) / size,
        len(_SYMBOL_END.findall(text)) / n,
        capitals / n,
        sum(map(text.count, "0123456789")) / size,
        text.count("|") / n,
        (text.count(".") + text.count("?")) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        1 - (pairs + 1) / n,
    ]


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bounds of at most ``bins`` quantile bins."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values over ordered bins, from the bins' sums of gradients and curvatures."""
    total_g, total_h = g.sum(), h.sum()
    leaf = np.full(len(g), total_g / (total_h + ridge))
    if depth == 0 or len(g) < 2:
        return leaf
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= 1e-9:
        return leaf
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1, ridge), shallow_tree(g[k:], h[k:], depth - 1, ridge)])


def crossed_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One cut along each axis of a grid of bins: four leaves; and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b, t = cg[:-1, :-1], cg[:-1, -1:], cg[-1, -1]
    c = cg[-1:, :-1]
    ha, hb, hc, ht = ch[:-1, :-1], ch[:-1, -1:], ch[-1:, :-1], ch[-1, -1]
    parts = [(a, ha), (b - a, hb - ha), (c - a, hc - ha), (t - b - c + a, ht - hb - hc + ha)]
    gain = sum(x**2 / (np.maximum(y, 0) + ridge) for x, y in parts)
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        x, y = parts[k]
        leaf[rows, cols] = x[i, j] / (max(y[i, j], 0) + ridge)
    return leaf, float(gain[i, j] - t**2 / (ht + ridge))


@dataclass
class AdditiveModel:
    """Bin bounds, one table for each feature, one for each chosen pair."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-np.clip(self.raw(self.binned(x)), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, rounds: int = 120, rate: float = 0.15, depth: int = 2, n_pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Boost the tables cyclically, then those of the best pairs."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [cut_points(x[:, j], bins) for j in range(x.shape[1])]
    b = model.binned(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-f))
            step = rate * shallow_tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), depth, ridge)
            model.tables[j] += step
            f += step[b[:, j]]
    flat = {(i, j): b[:, i] * sizes[j] + b[:, j] for i in range(len(sizes)) for j in range(i)}
    grid = lambda at, v, i, j: np.bincount(at, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    p = 1 / (1 + np.exp(-f))
    gains = {(i, j): crossed_tree(grid(at, y - p, i, j), grid(at, p * (1 - p), i, j), ridge)[1] for (i, j), at in flat.items()}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((sizes[k[0]], sizes[k[1]])) for k in chosen}
    for _ in range(rounds // 3):
        for i, j in chosen:
            p = 1 / (1 + np.exp(-f))
            at = flat[i, j]
            step = rate * crossed_tree(grid(at, y - p, i, j), grid(at, p * (1 - p), i, j), ridge)[0]
            model.pairs[i, j] += step
            f += step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 12000, modulus: int = 5, held: int = 0) -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of the id.

    Rows with crc32(doc_id) mod ``modulus`` equal to ``held``, null ids, null labels
    and null texts never train.  An id trains once: of repeated rows the smallest text
    counts, of labels that differ the smaller.  Without rows of both labels the model is
    the prior.
    The driver gets ``sample`` rows of ``len(NAMES)`` numbers.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(crc_mod("doc_id", modulus) != held).groupBy("doc_id").agg(F.min("quality").alias("__label"))
    chosen = sampled_ids(chosen, sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "__label").agg(F.min("text").alias("text")).select("doc_id", "text", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.quality import describe

        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([describe(x.as_py()) for x in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sorted((r["doc_id"], r["label"], r["x"]) for r in rows.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(NAMES)), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: AdditiveModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``name``: the chance of label 1 of the whole text.

    A null or empty text has all features 0 and gets a score like any other.  A column
    of ``docs`` already called ``name`` is replaced.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    docs = docs.drop(name)
    column = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.quality import describe

        for b in pieces(batches):
            x = np.array([describe(v.as_py() or "") for v in b.column(column)]).reshape(b.num_rows, -1)
            out = sent.value.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **how: int) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= ``threshold``).

    Nulls, empty texts, repeated rows and empty tables: see :func:`train` and
    :func:`score`; a null doc_id is scored and is not held out.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **how))
    held = crc_mod("doc_id", how.get("modulus", 5)) == how.get("held", 0)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **how: int) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; same columns."""
    scored = score(docs, train(docs, labels, **how), name="__score")
    return scored.where(F.col("__score") >= threshold).drop("__score")

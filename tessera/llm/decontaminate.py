"""Benchmark decontamination by template windows with slot consistency.

Words are canonicalised: numbers, units after numbers, and names (capitalised words
inside a sentence) become typed placeholders.  Windows of template words are hashed;
the windows of documents and of benchmark items meet in a hash join.  A match counts
only if the placeholders are filled consistently: one value of the item always stands
for one value of the document.  An item window with too few plain words for that is
matched word for word, numbers, units and names as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

WINDOW = 8
LEAST_LITERAL = 4
MEMO = 200_000
BROADCAST_WINDOWS = 200_000
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?;:\n]")
WORD, NAME, NUMBER, UNIT, STOP = range(5)
# Units that may follow a number, and numbers as words.
UNITS = frozenset("mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees mph kmh watt watts volt volts".split())
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_PLACE = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>", 7) for k in ("name", "number", "unit"))], np.uint64)
_BASE = 0x9E3779B97F4A7C15


class Templates:
    """Canonical word hashes of texts; remembers the words that it has met, within a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 2), np.uint64)

    def _learn(self, words: set[str]) -> None:
        first = len(self.known)
        if first + len(words) > len(self.table):
            grown = np.zeros((2 * (first + len(words)), 2), np.uint64)
            grown[:first] = self.table[:first]
            self.table = grown
        for i, w in enumerate(words, first):
            low = w.lower()
            kind = STOP if w in ".!?;:\n" else NUMBER if w[0].isdigit() or low in NUMBERS else UNIT if low in UNITS else NAME if w[0].isupper() else WORD
            self.known[w] = i
            self.table[i] = (xxhash.xxh64_intdigest(low, 3), kind)

    def __call__(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words without stops, their plain hashes, and their kinds."""
        words = _TOKEN.findall(text)
        if len(self.known) > MEMO:
            self.known.clear()
        try:
            at = list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.known))
            at = list(map(self.known.__getitem__, words))
        if not at:
            return [], np.zeros(0, np.uint64), np.zeros(0, np.int8)
        rows = self.table[at]
        kind = rows[:, 1].astype(np.int8)
        before = np.concatenate([[STOP], kind[:-1]])
        kind[(kind == UNIT) & (before != NUMBER)] = WORD
        kind[(kind == NAME) & (before == STOP)] = WORD
        real = kind != STOP
        if not real.all():
            words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
        return words, rows[real, 0], kind[real]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


def canonical(h: np.ndarray, kind: np.ndarray, names: bool) -> np.ndarray:
    """Word hashes with placeholders; ``names`` tells whether names count as such."""
    slot = np.where((kind == NAME) & (not names), WORD, kind)
    return np.where(slot == WORD, h, _PLACE[slot])


def windows(templates: Templates, text: str, sizes: list[int], literal_sizes: list[int]) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """(size, hashes, words, kinds) of a text: with placeholders, with names as they stand, and for ``literal_sizes`` with all words as they stand, where that differs."""
    words, h, kind = templates(text)
    forms = [(canonical(h, kind, True), kind, sizes)]
    if (kind == NAME).any():
        forms.append((canonical(h, kind, False), np.where(kind == NAME, WORD, kind), sizes))
    if literal_sizes and ((kind == NUMBER) | (kind == UNIT)).any():
        forms.append((h, np.zeros_like(kind), literal_sizes))
    for values, kept, wanted in forms:
        for size in wanted:
            yield size, window_hashes(values, size), words, kept


def slots(words: list[str], kind: np.ndarray, at: int, size: int) -> list[str]:
    """The placeholder values of a window: kind and lower-cased value, in order."""
    return [f"{k}{w.lower()}" for w, k in zip(words[at : at + size], kind[at : at + size].tolist(), strict=True) if k != WORD]


FOUND = "h long, item_id long, offset int, size int, slots array<string>, literal boolean, n_windows int, n_templates int"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of each distinct item: an item shorter than ``window`` is one window of its own length.

    Windows with fewer than ``LEAST_LITERAL`` plain words say too little as templates and
    are ``literal``: all words as they stand, no placeholders.  Null texts and null ids
    match nothing.
    """
    import pyarrow as pa

    ship(benchmark.sparkSession)
    schema = T._parse_datatype_string(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import decontaminate as d

        made = d.Templates()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, h, kind = made(text)
                size = min(window, len(words))
                if not size:
                    continue
                seen: dict[int, tuple[int, list[str], bool]] = {}
                plain = d.window_hashes(h, size).tolist()
                for names in (True, False):
                    values = d.window_hashes(d.canonical(h, kind, names), size)
                    for at, v in enumerate(values.tolist()):
                        part = kind[at : at + size]
                        literal = {w.lower() for w, k in zip(words[at : at + size], part.tolist(), strict=True) if k == d.WORD or (k == d.NAME and not names)}
                        if len(literal) >= d.LEAST_LITERAL:
                            if v not in seen:
                                kept = part if names else np.where(part == d.NAME, d.WORD, part)
                                seen[v] = (at, d.slots(words, np.concatenate([kind[:at], kept]), at, size), False)
                        elif not names and plain[at] not in seen:
                            seen[plain[at]] = (at, [], True)
                n = len({at for at, *_ in seen.values()})
                n_templates = len({at for at, _, whole in seen.values() if not whole})
                rows += [(v - (1 << 64) if v >> 63 else v, i, at, size, s, whole, n, n_templates) for v, (at, s, whole) in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.int32(), pa.int32()))], names=schema.names)

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    return items.mapInArrow(run, schema)


def document_windows(docs: DataFrame, sizes: list[int], literal_sizes: list[int], sieve: np.ndarray) -> DataFrame:
    """Windows of whole documents whose hash passes ``sieve``, a bit table of fixed size without false negatives."""
    import pyarrow as pa

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    shift = np.uint64(64 - (len(sieve) * 8 - 1).bit_length())
    schema = T._parse_datatype_string("doc_id long, at int, h long, slots array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import decontaminate as d

        made, bits = d.Templates(), sent.value
        for b in batches:
            ids, places, hashes, filled = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for size, values, words, kind in d.windows(made, text.as_py(), sizes, literal_sizes):
                    cell = values >> shift
                    for at in np.flatnonzero(bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).tolist():
                        ids.append(i)
                        places.append(at)
                        hashes.append(values[at])
                        filled.append(d.slots(words, kind, at, size))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64()), pa.array(filled, pa.list_(pa.string()))], names=schema.names)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def build_sieve(hashes: Iterator[int], count: int, most_bits: int = 28) -> np.ndarray:
    """A bit table of at least 64 bits a hash, up to ``2**most_bits`` bits (32 MB)."""
    size = min(most_bits, max(16, (64 * count).bit_length()))
    bits = np.zeros(1 << (size - 3), np.uint8)
    for h in hashes:
        cell = (h & (2**64 - 1)) >> (64 - size)
        bits[cell >> 3] |= 1 << (cell & 7)
    return bits


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, least: int = 3) -> DataFrame:
    """One row per (doc_id, item_id) whose passage the document holds.

    Columns: doc_id, item_id, n_matched (item windows found), n_windows, share, and
    re_parameterised (in every copy a number, name or unit differs).  A pair needs
    ``least`` windows of one copy, or all of an item that has fewer, filled consistently;
    or as many of its windows with placeholders alone.  Null ids and null texts match nothing, empty tables give none, repeated rows count once, other columns of
    the inputs are not read.
    """
    items = item_windows(benchmark, window).cache()
    try:
        count = items.count()
        sized = items.select("size", "literal").distinct().collect()
        sizes = sorted({r[0] for r in sized}) or [window]
        literal_sizes = sorted(r[0] for r in sized if r[1])
        sieve = build_sieve((r[0] for r in items.select("h").toLocalIterator()), count)
    finally:
        items.unpersist()
    side = F.broadcast(items) if count <= BROADCAST_WINDOWS else items
    found = document_windows(docs, sizes, literal_sizes, sieve).distinct()
    met = found.withColumnRenamed("slots", "filled").join(side, "h").where(F.size("filled") == F.size("slots"))
    value = F.explode_outer(F.when(F.size("slots") == 0, F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(F.zip_with("slots", "filled", lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = met.select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("start"), "offset", "literal", "n_windows", "n_templates", value.alias("s"))
    by_value = pairs.groupBy("doc_id", "item_id", "start", "literal", F.col("s.a").alias("a")).agg(F.min("s.b").alias("low"), F.max("s.b").alias("high"), F.collect_set("offset").alias("at"), F.max("n_windows").alias("n_windows"), F.max("n_templates").alias("n_templates"))
    fits = F.col("a").isNull() | (F.col("low") == F.col("high"))
    held = lambda c: F.flatten(F.collect_list(F.when(c, F.col("at"))))
    places = lambda c: F.size(F.array_except(held(c), held(c & ~fits)))  # noqa: E731  windows of which every slot fits
    flat = by_value.groupBy("doc_id", "item_id", "start").agg(
        places(F.lit(True)).alias("n_matched"),
        places(~F.col("literal")).alias("n_filled"),
        F.max("n_windows").alias("n_windows"),
        F.max("n_templates").alias("n_templates"),
        F.coalesce(F.bool_or((F.col("a") != F.col("low")) & (F.col("low") == F.col("high"))), F.lit(False)).alias("re_parameterised"),
    )
    filled = (F.col("n_templates") > 0) & (F.col("n_filled") >= F.least(F.lit(least), F.col("n_templates")))
    kept = flat.where(filled | (F.col("n_matched") >= F.least(F.lit(least), F.col("n_windows"))))
    kept = kept.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.bool_and("re_parameterised").alias("re_parameterised"))
    return kept.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("share"), "re_parameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; same columns; rows without an id stay."""
    gone = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti").select(*[docs[c] for c in docs.columns])

"""Language by cross-parsing entropy: how few phrases of a language's text make up a document.

The labelled text of each language becomes a suffix automaton.  A document is parsed
against each: a phrase is the longest run from where the last one ended that stands
anywhere in the language's text (one letter where not even that does).  With c phrases
over n letters and m letters of labelled text, c * log2(m) / n estimates the cross
entropy in bits a letter, and the language with the fewest wins.

All edges of all automata are one table, so that a step of many parses at once is a few
vector operations.  Texts are parsed in blocks of ``BLOCK`` letters, every
block of a text on its own: a phrase ends at the edge of a block at the latest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, pieces, ship

BLOCK = 1024
#: Labelled text: pieces of so many letters, at most so many letters a language and over all languages.
PIECE, LETTERS, ALL_LETTERS = 500, 60_000, 400_000
#: Letters that a worker parses at once.
MOST_AT_ONCE = 4_000_000
UNKNOWN = "und"
_SPACE = 32

_CHARACTERS: list[np.ndarray] = []


def characters() -> np.ndarray:
    """Code point to its lower-case letter, or a space for what is no letter."""
    if not _CHARACTERS:
        made = np.full(0x110000, _SPACE, np.int32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                made[i] = ord(c.lower()[0])
        _CHARACTERS.append(made)
    return _CHARACTERS[0]


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, one space for whatever stands between them; none at the ends."""
    found = characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(found != _SPACE)
    if not len(at):
        return found[:0]
    found = found[at[0] : at[-1] + 1]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != _SPACE) | (found[:-1] != _SPACE)
    return found[keep]


def bounded(texts: Iterable[str], most: int = MOST_AT_ONCE) -> Iterator[list[np.ndarray]]:
    """Letters of texts, in lists of about ``most`` letters: one text more at the most."""
    group, size = [], 0
    for text in texts:
        group.append(letters(text))
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def suffix_automaton(symbols: Iterable[int]) -> list[dict[int, int]]:
    """Edges by state; state 0 is the start, and every walk from it spells a run of ``symbols``."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new, p = len(edges), last
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(edges[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def place(edges: list[dict[int, int]], width: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Row displacement: an offset for each state, no two alike, so that (offset + symbol) is a slot of one edge only.

    Symbols are 1 to ``width``.  States with many edges are placed first; a state with one
    takes the next free slot.  Gives the offsets, and slot to (offset, state reached).
    """
    offsets, slots, taken = [0] * len(edges), {}, set()
    at = 0
    for s in sorted(range(len(edges)), key=lambda s: (-len(edges[s]), s)):
        out = edges[s]
        first, tries = min(out, default=1), 0
        offset = max(at - first, 0)
        while offset in taken or any(offset + c in slots for c in out):
            offset += 1
            tries += 1
        if tries > 16 or len(out) < 2:
            at = offset + first  # what lies before is about full
        offsets[s] = offset
        taken.add(offset)
        for c, t in out.items():
            slots[offset + c] = (offset, t)
    return offsets, slots


@dataclass
class Model:
    """All automata in one table.

    A state is known by its offset; slot offset + symbol holds the offset of the state
    that the edge leaves (``owner``) and of the one that it reaches (``reached``).
    ``first`` gives the state after a phrase's first symbol, by language; the state
    ``idle``, which no edge leaves, follows a letter that the language has not.
    """

    languages: list[str]
    sizes: np.ndarray
    alphabet: np.ndarray
    owner: np.ndarray
    reached: np.ndarray
    first: np.ndarray

    @property
    def idle(self) -> int:
        return len(self.owner) - len(self.alphabet) - 2

    @classmethod
    def of(cls, texts: dict[str, list[np.ndarray]]) -> Model:
        """Automata of each language's pieces, which are kept apart by a symbol that no text has."""
        names = sorted(texts)
        alphabet = np.unique(np.concatenate([np.zeros(0, np.int32), *[p for name in names for p in texts[name]]]))
        stop, roots, sizes, every, states = len(alphabet) + 1, [], [], [], 0
        for name in names:
            symbols = [c for piece in texts[name] for c in (*(np.searchsorted(alphabet, piece) + 1).tolist(), stop)]
            edges = suffix_automaton(symbols)
            roots.append(states)
            sizes.append(len(symbols))
            every += [{c: states + t for c, t in out.items()} for out in edges]
            states += len(edges)
        offsets, slots = place(every, stop)
        idle = max(offsets, default=0) + stop + 1
        owner = np.full(idle + stop + 1, -1, np.int32)
        reached = np.zeros(len(owner), np.int32)
        for slot, (left, state) in slots.items():
            owner[slot], reached[slot] = left, offsets[state]
        first = np.array([[offsets[every[r][c]] if c in every[r] else idle for c in range(stop + 1)] for r in roots], np.int32)
        return cls(names, np.array(sizes, np.int64), alphabet, owner, reached, first)

    def symbols(self, text: np.ndarray) -> np.ndarray:
        """Letters as symbols of the table; 0, which no edge has, for a letter that no language has."""
        if not len(self.alphabet):
            return np.zeros(len(text), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        n = len(self.languages)
        out = np.zeros((len(texts), n), np.int64)
        ends = np.cumsum([0, *map(len, texts)])
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // block) for t in texts])
        if not len(owner) or not n:
            return out
        begins = np.concatenate([np.arange(a, b, block) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        sizes = np.minimum(block, ends[owner + 1] - begins)
        longest = np.argsort(-sizes, kind="stable")
        begins, sizes, owner = begins[longest], sizes[longest], owner[longest]
        flat = self.symbols(np.concatenate(texts))
        state = np.full((n, len(begins)), self.idle, np.int32)
        found = np.zeros((n, len(begins)), np.int32)
        active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=block + 1))  # blocks with more than t letters
        for t in range(int(sizes[0])):
            m = int(active[t])
            symbol = flat[begins[:m] + t]
            slot = state[:, :m] + symbol
            new = self.owner[slot] != state[:, :m]  # no edge: a phrase begins with this letter
            found[:, :m] += new
            state[:, :m] = np.where(new, self.first[:, symbol], self.reached[slot])
        np.add.at(out, owner, found.T)
        return out

    def judge(self, texts: list[np.ndarray]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the likelihoods a letter; ``und`` and 0 for a text without letters."""
        counts = self.phrases(texts)
        names, scores = [], []
        for text, row in zip(texts, counts, strict=True):
            if not len(text) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            bits = row * np.log2(np.maximum(self.sizes, 2)) / len(text)
            best = int(np.argmin(bits))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp2(bits[best] - bits).sum()))
        return names, scores


def train(docs: DataFrame, *, modulus: int = 3, held: int = 1, piece: int = PIECE, per_language: int = LETTERS, total: int = ALL_LETTERS) -> Model:
    """Automata of a bounded sample of the labelled text.

    Every labelled text is cut into pieces of ``piece`` letters; of each language the
    distinct pieces with the smallest hash are taken, up to ``per_language`` letters and,
    over all languages, ``total`` letters (languages share it equally).  That bounds the
    model to about 3 edges a letter, whatever the table and however many languages.
    Rows with crc32(doc_id) mod ``modulus`` equal to ``held``, rows without id, text or
    lang, and texts without letters do not train; a piece that repeats trains once.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(crc_mod("doc_id", modulus) != held).select("lang", "text")

    def cut(limits: dict[str, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tessera.llm.language import letters

            for b in pieces(batches, 200):
                langs, hashes, texts = [], [], []
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = letters(text)
                    limit = None if limits is None else limits.get(lang, -1)
                    for at in range(0, len(found), piece):
                        made = found[at : at + piece].tobytes()
                        h = xxhash.xxh64_intdigest(made) >> 1
                        if limit is None or h <= limit:
                            langs.append(lang)
                            hashes.append(h)
                            texts.append(made)
                columns = [pa.array(langs, pa.string()), pa.array(hashes, pa.int64())]
                if limits is None:
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "h"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=["lang", "h", "piece"])

        return run

    known = rows.mapInArrow(cut(None), "lang string, h long").groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not known:
        return Model.of({})
    each = max(1, min(per_language, total // len(known)) // piece)
    # Twice as many pieces as asked for pass the limit; only those are sorted.
    limits = {r["lang"]: int((2**63 - 1) * min(1.0, 2 * each / max(1, r["n"]))) for r in known}
    passed = rows.mapInArrow(cut(limits), "lang string, h long, piece binary").distinct()
    ranked = passed.selectExpr("lang", "piece", "row_number() OVER (PARTITION BY lang ORDER BY h, piece) AS k").where(F.col("k") <= each)
    texts: dict[str, list[np.ndarray]] = {}
    for r in ranked.orderBy("lang", "k").collect():
        texts.setdefault(r["lang"], []).append(np.frombuffer(r["piece"], np.int32))
    return Model.of(texts)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score.

    A null text, or one without a letter, is ``und`` with score 0.0, and so is every
    text where no language was learned.  Ties go to the first language by name.
    Columns of these two names are replaced.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.language import bounded

        for b in pieces(batches):
            names, scores = [], []
            for group in bounded(x.as_py() or "" for x in b.column(column)):
                judged = sent.value.judge(group)
                names += judged[0]
                scores += judged[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def languages(docs: DataFrame, *, modulus: int = 3, held: int = 1, **how: int) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    A null doc_id is predicted and is not held out; repeated rows are predicted each;
    an empty table gives no row.  lang, source and doc_id are no input of a prediction.
    """
    model = train(docs, modulus=modulus, held=held, **how)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")

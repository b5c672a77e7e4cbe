"""Exact token counts by a compiled finite-state transducer over merge-based vocabularies.

The merge list is compiled, state by state as texts need them, into a deterministic
transducer over the bytes of a pre-token (:class:`WordTransducer`).  A state is the
longest suffix read that begins some token, with the last token and the relative count
at each place of it; that is all that later steps can look at, so states are finitely
many and words with a common inner part share them.  A transition carries the number of
tokens that the best encoding gains.  A second transducer (:class:`Scanner`) reads the
characters of a normalised text, cuts pre-tokens by their classes, and drives the first.

A text is read in chunks.  A chunk is a map of the scanner's states to states and counts
(:class:`ChunkMap`): after its first white space it no longer depends on the state that
it is entered in.  The maps form a monoid under composition, so the counts up to every
chunk are a parallel prefix scan over them (:func:`prefix_scan`).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces, ship

OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
CHUNK = 1 << 11
#: Compiled states that a worker keeps before it compiles anew; counts do not depend on it.
MOST_STATES = 250_000
#: Runs between spaces whose gain from the start state a worker remembers.
MOST_RUNS = 800_000
#: Fixed value: the one pre-token pattern that the scanner is built for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in shown:
            shown[b], extra = chr(extra), extra + 1
    return [shown[b] for b in range(256)]


class WordState(dict):
    """A state of the word transducer: byte symbol to (state, tokens gained); ``ends`` has the gain where the word ends with it."""

    __slots__ = ("back", "ends", "suffix")

    def __init__(self, suffix: str, back: tuple[tuple[str, int], ...]) -> None:
        self.suffix, self.back = suffix, back
        self.ends: dict[str, int] = {}


class WordTransducer:
    """Counts the tokens of one pre-token; deterministic, compiled as bytes are met.

    The encoding of a prefix ends in exactly one token, and it is the one suffix token
    whose pair with the token before it is stable under the merges.  A token that ends
    later begins within the suffix of a state, so the last tokens at the places of that
    suffix (``back``: nearest first, with counts relative to the present one) suffice.
    The final symbol of a word has its own alphabet (word end).
    """

    def __init__(self, merges: list[tuple[str, str]], end: str) -> None:
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end = end
        self.tokens = {a + b for a, b in merges} | set(byte_symbols()) | {b + end for b in byte_symbols()}
        stems = {t.removesuffix(end) for t in self.tokens}
        self.begins = {s[:i] for s in stems for i in range(len(s))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, WordState] = {}
        self.start = self.state("", (("", 0),))

    def state(self, suffix: str, back: tuple[tuple[str, int], ...]) -> WordState:
        """The one state of a suffix and its places."""
        key = (suffix, back)
        if (known := self.states.get(key)) is None:
            known = self.states[key] = WordState(suffix, back)
        return known

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges by rank, the leftmost of equals first, until none is left."""
        rank, never = self.rank.get, 1 << 30
        symbols = list(symbols)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def symbols(self, written: str) -> list[str]:
        stem = written.removesuffix(self.end) if self.end else written
        out = list(stem)
        if self.end and stem != written:
            out[-1] += self.end
        return out

    def stable(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.merge(self.symbols(left) + self.symbols(right)) == [x for x in key if x]
        return known

    def last(self, at: WordState, symbol: str, final: bool) -> tuple[str, int]:
        """Last token and gain once ``symbol`` has been read in a state."""
        read = at.suffix + symbol
        for size in range(len(read), 0, -1):
            token = read[-size:] + (self.end if final else "")
            if token in self.tokens:
                before, count = at.back[size - 1]
                if self.stable(before, token):
                    return token, count + 1
        raise ValueError("the merges leave a symbol that is no token")

    def step(self, at: WordState, symbol: str) -> tuple[WordState, int]:
        """The state after a symbol that does not end the word, and the tokens gained."""
        if (known := at.get(symbol)) is None:
            token, gain = self.last(at, symbol, False)
            suffix = at.suffix + symbol
            while suffix not in self.begins:
                suffix = suffix[1:]
            back = ((token, 0), *((t, n - gain) for t, n in at.back[: len(suffix)]))
            known = at[symbol] = (self.state(suffix, back), gain)
        return known

    def ending(self, at: WordState, symbol: str) -> int:
        """The tokens gained by a symbol that ends the word."""
        if (known := at.ends.get(symbol)) is None:
            known = at.ends[symbol] = self.last(at, symbol, True)[1]
        return known

    def emitted(self, word: str) -> list[int]:
        """The counts on the transitions of a pre-token in byte symbols; they add up to its tokens."""
        at, out = self.start, []
        for symbol in word[:-1]:
            at, gain = self.step(at, symbol)
            out.append(gain)
        return [*out, self.ending(at, word[-1])]

    def count(self, word: str) -> int:
        """Tokens of a pre-token in byte symbols."""
        at, total = self.start, 0
        for symbol in word[:-1]:
            found = at.get(symbol) or self.step(at, symbol)
            at = found[0]
            total += found[1]
        end = at.ends.get(word[-1])
        return total + (self.ending(at, word[-1]) if end is None else end)


class ScanState(dict):
    """A state of the scanner: character to (state, tokens gained); ``closing``: what is gained if the text ends."""

    __slots__ = ("closing", "kind", "word")

    def __init__(self, kind: str, word: WordState | None = None, closing: int = 0) -> None:
        self.kind, self.word, self.closing = kind, word, closing


class Scanner:
    """The transducer over characters: pre-tokens by class, contractions, and the word transducer within.

    The last byte of a pre-token counts otherwise than one within it, so a state holds
    the word's state as if it went on, and ``closing`` corrects the count where it ends.
    """

    def __init__(self, words: WordTransducer) -> None:
        self.words, self.shown = words, byte_symbols()
        self.letter, self.number, self.space = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
        self.states: dict[tuple, ScanState] = {}
        self.start = self.state("start")

    def state(self, kind: str, word: WordState | None = None, closing: int = 0) -> ScanState:
        key = (kind, id(word), closing)
        if (known := self.states.get(key)) is None:
            known = self.states[key] = ScanState(kind, word, closing)
        return known

    def read(self, word: WordState, char: str) -> tuple[WordState, int, int]:
        """The word's state after all bytes of a character, the tokens gained, and the correction if the word ends there."""
        *inner, last = (self.shown[b] for b in char.encode())
        gained = 0
        for symbol in inner:
            word, n = self.words.step(word, symbol)
            gained += n
        after, n = self.words.step(word, last)
        return after, gained + n, self.words.ending(word, last) - n

    def whole(self, word: str) -> int:
        """Tokens of a pre-token on its own."""
        return self.words.count("".join([self.shown[b] for b in word.encode()]))

    def run(self, kind: str, word: WordState, char: str) -> tuple[ScanState, int]:
        word, gained, closing = self.read(word, char)
        return self.state(kind, word, closing), gained

    def compile(self, at: ScanState, c: str) -> tuple[ScanState, int]:
        """The transition of a character that a state has not met yet."""
        kind = "letters" if self.letter.match(c) else "number" if self.number.match(c) else "space" if self.space.match(c) else "other"
        if at.kind == kind and at.word is not None:
            return self.run(kind, at.word, c)
        if at.kind == "'":
            if c in "stmd":
                return self.start, self.whole("'" + c)
            if c in "rvl":
                letters, gained = self.run("letters", self.words.start, c)
                return self.state("'" + c, letters.word, self.whole("'") + gained + letters.closing), 0
            if kind == "other":
                after, gained, _ = self.read(self.words.start, "'")
                state, more = self.run(kind, after, c)
                return state, gained + more
        if at.kind in ("'r", "'v", "'l"):
            if c == ("l" if at.kind == "'l" else "e"):
                return self.start, self.whole(at.kind + c)
            letters, gained = self.run("letters", self.words.start, at.kind[1])
            state, more = self.move(letters, c)
            return state, self.whole("'") + gained + more
        if kind == "space":
            return self.start, at.closing
        if kind == "number":
            return self.start, at.closing + self.whole(c)
        if c == "'":
            return self.state("'", None, self.whole("'")), at.closing
        state, gained = self.run(kind, self.words.start, c)
        return state, at.closing + gained

    def move(self, at: ScanState, c: str) -> tuple[ScanState, int]:
        if (known := at.get(c)) is None:
            known = at[c] = self.compile(at, c)
        return known

    def scan(self, at: ScanState, text: str) -> tuple[ScanState, int]:
        """State after a text, and the tokens gained."""
        total = 0
        for c in text:
            try:
                at, gained = at[c]
            except KeyError:
                at, gained = self.move(at, c)
            total += gained
        return at, total


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to a state of the scanner: the state after it, and the tokens gained.

    ``head`` is read from the state that the chunk is entered in; it reaches to the
    first white space, after which all states are one.  From there the chunk gains
    ``count`` and leaves in ``leaves``.  Without white space ``leaves`` is None and
    ``head`` is the whole chunk.
    """

    head: str
    count: int = 0
    leaves: ScanState | None = None

    def apply(self, scanner: Scanner, at: ScanState) -> tuple[ScanState, int]:
        at, gained = scanner.scan(at, self.head)
        return (at, gained) if self.leaves is None else (self.leaves, gained + self.count)


class Runs(dict):
    """Run without spaces to the tokens gained from the start state to the start state by it and the space after it."""

    def __init__(self, scanner: Scanner) -> None:
        self.scanner, self.pattern = scanner, regex.compile(PATTERN)

    def __missing__(self, run: str) -> int:
        known = self[run] = sum(map(self.scanner.whole, self.pattern.findall(run)))
        return known


class Tokenizer:
    """A compiled vocabulary file: normaliser, special strings, scanner."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != PATTERN:
            raise ValueError("a vocabulary with another pre-token pattern")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.space = regex.compile(r"\s")
        self.words = WordTransducer(merges, model["end_of_word_suffix"])
        self.scanner = Scanner(self.words)
        self.runs = Runs(self.scanner)

    def renew(self) -> None:
        """Forget what has been compiled, once it is more than a bound."""
        if len(self.scanner.states) + len(self.words.states) > MOST_STATES:
            self.words.states.clear()
            self.words.pairs.clear()
            self.words.start = self.words.state("", (("", 0),))
            self.scanner = Scanner(self.words)
            self.runs.scanner = self.scanner
        if len(self.runs) > MOST_RUNS:
            self.runs.clear()

    def normalise(self, text: str) -> str:
        """Composed form, then lower case sign by sign (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunk(self, text: str) -> ChunkMap:
        """The map of a piece of a normalised text."""
        first = self.space.search(text)
        if first is None:
            return ChunkMap(text)
        *runs, tail = text[first.end() :].split(" ")
        count = sum(map(self.runs.__getitem__, runs))
        leaves, gained = self.scanner.scan(self.scanner.start, tail)
        return ChunkMap(text[: first.end()], count + gained, leaves)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.leaves is None:
            return ChunkMap(a.head + b.head, b.count, b.leaves)
        leaves, gained = b.apply(self.scanner, a.leaves)
        return ChunkMap(a.head, a.count + gained, leaves)

    def counts(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Tokens up to the end of each chunk of a text, were it to end there; a special string is one token of its own."""
        out, before = [], 0
        parts = self.special.split(text) if "<|" in text else [text]
        for i, part in enumerate(parts):
            self.renew()
            whole = self.normalise(part)
            maps = [self.chunk(whole[k : k + chunk]) for k in range(0, len(whole), chunk)]
            for m in prefix_scan(maps, self.compose):
                state, gained = m.apply(self.scanner, self.scanner.start)
                out.append(before + gained + state.closing)
            before = out[-1] if maps else before
            if i + 1 < len(parts):
                before += 1
                out.append(before)
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        return (self.counts(text, chunk) or [0])[-1]


def prefix_scan(items: list, op: Callable) -> list:
    """Inclusive scan in log2(n) rounds and 2 n compositions: pairs are joined, their scan fills the places between."""
    if len(items) < 2:
        return list(items)
    pairs = prefix_scan([op(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], op)
    return [items[0] if i == 0 else pairs[i // 2] if i % 2 else op(pairs[i // 2 - 1], x) for i, x in enumerate(items)]


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One compiled tokenizer per worker process; it keeps what it has compiled."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """``keep`` columns, then ``n_bytes`` and ``n_tokens`` of each row's whole ``text``.

    ``path`` names the vocabulary file on the driver; workers get it as a file of the
    Spark context.  A null text counts as empty (0 bytes, 0 tokens); repeated rows are
    counted each; an empty table gives none.  Only ``keep`` and ``text`` leave the
    reader, so other columns cannot clash.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    context, file = docs.sparkSession.sparkContext, Path(path).name
    sent = context.__dict__.setdefault("_tessera_files", {})
    if sent.get(file) != path:
        context.addFile(path)
        sent[file] = path
    schema = T.StructType([docs.schema[c] for c in keep] + OUT.fields)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.token_count import load

        tok = load(SparkFiles.get(file))
        for b in pieces(batches):
            size, tokens = [], []
            for v in b.column(len(names)):
                s = v.as_py() or ""
                size.append(len(s.encode()))
                tokens.append(tok.count(s, chunk))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return docs.select(*names, docs[text].alias("__text")).mapInArrow(run, schema)

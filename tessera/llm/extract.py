"""Main text of web pages by the maximum-scoring run of tokens.

A page becomes tokens: words and tags.  Words score positive and tags negative; words
inside links or page furniture are kinds of their own and score negative too.  The
weights are log odds of the token kinds inside and outside the main text of labelled
pages: those that mark their main text themselves (``article``, ``main``), whose marks
only label and are no features of the words.  One linear scan finds the run with the
highest sum, and its blocks, but for furniture, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

# Element and class names of page furniture, block elements, void elements.
FURNITURE = frozenset("nav header footer aside form button select option textarea input label script style noscript template iframe svg math canvas object embed audio video dialog menu head title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted popup modal cookie cookies consent notice notices newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar comment comments commentlist disqus replies respond widget outbrain taboola copyright disclaimer toc".split())
# Words of layout that class names of furniture are put together with.
LAYOUT = frozenset("area bar block bottom box button buttons cell col column container content desktop entry field fixed float form frame group head heading icon icons inline inner item items js label layout left link links list main mobile outer panel primary right row secondary section slot small sticky tab tabs text thread title top unit wide wrap wrapper zone".split())
NEGATED = frozenset("has with no without".split())
HOLDERS = frozenset({"article", "main"})
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
MORE = frozenset("p li dd dt td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_ROOT = ("#root", False, 0)


def is_furniture(name: str, attributes: str, inside_holder: bool) -> bool:
    """Does this element hold page furniture, by its name or by its class, id or role?

    Inside the main text a class or id must say nothing else: ``related-work`` is a part
    of an article, ``related-links`` is not.
    """
    if name in FURNITURE:
        return not (inside_holder and name == "header")
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                parts = set(_PART.findall(one))
                if parts & MARKED and not parts & NEGATED and not (inside_holder and (parts & MARKED == {"header"} or not parts <= MARKED | LAYOUT)):
                    return True
    return False


class Page:
    """Blocks of text with their elements, and the tokens that the scan scores."""

    def __init__(self, source: str) -> None:
        self.texts: list[str] = []  # per block
        self.words: list[int] = []
        self.linked: list[int] = []
        self.tags: list[list[str]] = []  # before the block
        self.paths: list[tuple[int, ...]] = []
        self.furniture: list[bool] = []
        self.names: list[str] = ["#root"]
        self._stack: list[tuple[int, str, bool]] = [(0, "#root", False)]
        self._parts: list[str] = []
        self._link_words, self._links, self._pending = 0, 0, []
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name:
                self._tag(name.lower(), bool(m[2] or m[5]), m[4] or m[7] or "")
        self._text(source[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        if piece:
            self._parts.append(piece)
            if self._links:
                self._link_words += len(piece.split())

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.texts.append(text)
                self.words.append(text.count(" ") + 1)
                self.linked.append(self._link_words)
                self.tags.append(self._pending)
                self._pending = []
                self.paths.append(tuple(i for i, _, _ in self._stack))
                self.furniture.append(self._stack[-1][2])
        self._parts, self._link_words = [], 0

    def _tag(self, name: str, closing: bool, attributes: str) -> None:
        block = name in BLOCKS
        if name == "br":
            self._parts.append(" ")
        elif block:
            self._flush()
        if name == "a":
            self._links = 0 if closing else 1
        if closing:
            if any(n == name for _, n, _ in self._stack):
                if not block and self._stack[-1][1] != name and self._parts and any(f for _, n, f in self._stack):
                    self._flush()
                while (top := self._stack.pop())[1] != name:
                    pass
                if top[2] and not self._stack[-1][2]:
                    self._flush_as(top)
        else:
            if name in MORE:
                self._close_open(name)
            inside = self._stack[-1][2] or is_furniture(name, attributes, any(n in HOLDERS for _, n, _ in self._stack))
            if inside and not self._stack[-1][2]:
                self._flush()
            if name not in VOID and not attributes.endswith("/"):
                self.names.append(name)
                self._stack.append((len(self.names) - 1, name, inside))
        self._pending.append(("/" if closing else "") + name)

    def _flush_as(self, top: tuple[int, str, bool]) -> None:
        """Text before the end of inline furniture belongs to it."""
        self._stack.append(top)
        self._flush()
        self._stack.pop()

    def _close_open(self, name: str) -> None:
        """A new paragraph or item ends an open one; inline elements left open end with it."""
        for k in range(len(self._stack) - 1, 0, -1):
            n = self._stack[k][1]
            if n == name or (name in ("dd", "dt") and n in ("dd", "dt")) or (name in ("td", "th") and n in ("td", "th")):
                del self._stack[k:]
                return
            if n in BLOCKS and n != "p":
                return


def token_kinds(page: Page) -> list[list[tuple[str, int]]]:
    """Per block: (kind, how many) of the tokens before it and in it."""
    out = []
    for tags, words, linked, furniture in zip(page.tags, page.words, page.linked, page.furniture, strict=True):
        linked = min(linked, words)
        plain = [("furniture", words)] if furniture else [("word", words - linked), ("link word", linked)]
        out.append([*Counter("<" + t for t in tags).items(), *(p for p in plain if p[1])])
    return out


def labelled_counts(source: str) -> tuple[Counter, Counter]:
    """Token kinds inside and outside the main text of a page that marks it; empty for a page that does not."""
    page = Page(source)
    inside, outside = Counter(), Counter()
    marked = [any(page.names[i] in HOLDERS for i in path) for path in page.paths]
    if any(marked):
        for kinds, held, furniture in zip(token_kinds(page), marked, page.furniture, strict=True):
            (inside if held and not furniture else outside).update(dict(kinds))
    return inside, outside


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Weights of token kinds: log odds inside against outside; plain words stay positive, all else negative."""
    total_in, total_out = sum(inside.values()), sum(outside.values())
    kinds = {*inside, *outside, "word", "link word", "furniture"}
    odds = {k: math.log((inside.get(k, 0) + 0.5) / (total_in + len(kinds))) - math.log((outside.get(k, 0) + 0.5) / (total_out + len(kinds))) for k in kinds}
    return {k: max(0.5, min(v, 1.5)) if k == "word" else max(-0.5, min(v, -0.1)) if k in ("link word", "furniture") else max(-2.0, min(v, -0.05)) for k, v in odds.items()}


#: Weights where no labelled page is at hand; an unknown tag scores ``UNKNOWN``.
WEIGHTS = {"word": 1.0, "link word": -0.5, "furniture": -0.5}
UNKNOWN = -0.1


def learn(pages: DataFrame, sample: int = 2000) -> dict[str, float]:
    """Weights from about ``sample`` pages that mark their main text, those with the smallest hash of the url and page_id.

    Executors count; the driver gets two numbers for each token kind.  Element names
    that are no HTML elements count as one kind, so kinds are bounded.  Without a page
    that marks its main text the weights are ``WEIGHTS``.
    """
    import pyarrow as pa

    ship(pages.sparkSession)
    pages = pages.where("html IS NOT NULL")
    n = pages.count()
    if n > sample:
        h = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1)
        pages = pages.where(h < F.lit(int(2**63 * (sample / n))).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import extract as e

        known = {f"<{x}{name}" for x in ("", "/") for name in (*e.BLOCKS, *e.FURNITURE, *e.VOID, *e.INLINE)}
        both = Counter(), Counter()
        for b in batches:
            for x in b.column(0):
                for total, one in zip(both, e.labelled_counts(x.as_py()), strict=True):
                    for kind, k in one.items():
                        total[kind if kind[0] != "<" or kind in known else "<other"] += k
        kinds = sorted({*both[0], *both[1]})
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array([c[k] for k in kinds], pa.int64()) for c in both)], names=["kind", "n_in", "n_out"])

    counted = pages.select("html").mapInArrow(run, "kind string, n_in long, n_out long")
    got = counted.groupBy("kind").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).collect()
    if not any(r["n_in"] for r in got):
        return dict(WEIGHTS)
    return weights_of({r["kind"]: r["n_in"] for r in got}, {r["kind"]: r["n_out"] for r in got})


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the highest sum, the longest of equals; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best > 0 and i + 1 - start > span[1] - span[0]):
            best, span = total, (start, i + 1)
    return span


def main_text(source: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The page's main text: blocks in page order, two line breaks between them; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    scores, starts, ends = [], [], []
    other = weights.get("<other", UNKNOWN)
    for kinds in token_kinds(page):
        for kind, n in kinds:  # equal tokens side by side are one step of the scan
            scores.append(n * weights.get(kind, other))
            if kind[0] != "<":
                starts.append(len(scores) - 1) if len(starts) == len(ends) else None
        ends.append(len(scores))
    a, b = best_run(scores)
    return "\n\n".join(t for t, s, e, furniture in zip(page.texts, starts, ends, page.furniture, strict=True) if s < b and e > a and not furniture)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, sample: int = 2000) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points), with ``weights`` or those learned from ``pages``.

    A null or empty html gives an empty text and 0; broken markup is read as far as it
    goes; repeated rows stay; an empty table gives none; other columns are not read.
    """
    import pyarrow as pa

    ship(pages.sparkSession)
    if weights is None:
        weights = learn(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.extract import main_text

        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col("page_id"), "url", "html").mapInArrow(run, schema)

"""Component names: normal forms, reversible shapes, slugs, and reasons for no answer."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import trim_all

# Vendor prefixes in the order they are tried, and archive endings.
PREFIXES = ("golang-", "python-", "node-", "perl-", "ruby-", "rust-", "java-", "php-", "lib")
ENDINGS = "jar whl tar.gz tgz tar zip exe dll so gem nupkg crate deb rpm"
NORM_ENDINGS = "jar whl tar.gz tgz zip exe dll so"

_any = lambda endings: "|".join(re.escape(e) for e in endings.split())
# The steps of the published normal form, in order.
_STEPS = ((rf"\.({_any(NORM_ENDINGS)})$", ""), (r"\s*\([^)]*\)\s*$", ""), (r"[_\s]+", "-"), (r"-v?\d[\d.\-_a-z]*$", ""), (r"^-+|-+$", ""))


def norm(c: Column) -> Column:
    """The normal form of a name: lower case, no ending, parenthesis or version, hyphens."""
    out = F.lower(trim_all(c))
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def norm_text(s: str) -> str:
    """:func:`norm` of one Python string."""
    out = s.strip().lower()
    for pattern, by in _STEPS:
        out = re.sub(pattern, by, out)
    return out


def _reversals() -> list[tuple[re.Pattern, str, bool]]:
    """(pattern, replacement, trim after it) of every shape that is taken back, in the order they are tried."""
    shapes = [(rf"\.({_any(ENDINGS)})$", "", False), (r"\s*\([^)]*\)\s*$", "", True), (r"[-_\s]v?\d[\d.\-_a-z]*$", "", True), (r"[_\s]+", "-", False)]
    prefixes = [(rf"^{re.escape(p)}(?=(?s:...))", "", False) for p in PREFIXES]
    return [(re.compile(pattern, re.I), by, trim) for pattern, by, trim in [*shapes, *prefixes]]


REVERSALS = _reversals()


def candidate_forms(name: str, limit: int = 64, depth: int = 4) -> list[str]:
    """Forms of a name worth looking up: a breadth-first search over up to ``depth`` reversals.

    A form stands as written, in lower case and in its normal form, if it has two
    characters or more; what is known already is not taken apart again.
    """
    known: dict[str, None] = {}
    queue = deque([(name.strip(), 0)])

    def add(form: str) -> None:
        bare = form.strip()
        if len(bare) > 1:
            known.update((f, None) for f in (bare, bare.lower(), norm_text(bare)) if len(f) > 1)

    add(name)
    while queue and len(known) < limit:
        form, taken = queue.popleft()
        for pattern, by, trim in REVERSALS if taken < depth else ():
            shorter = pattern.sub(by, form)
            shorter = shorter.strip() if trim else shorter
            if shorter != form and shorter not in known:
                add(shorter)
                queue.append((shorter, taken + 1))
    return list(known)[:limit]


def _candidate_series(names: pd.Series) -> pd.Series:
    made = {n: candidate_forms(n) for n in names.dropna().unique()}
    return names.map(lambda n: made.get(n, []))


def candidates(c: Column | str) -> Column:
    """:func:`candidate_forms` of a column; work is done once for each distinct name of a batch."""
    return F.pandas_udf(_candidate_series, "array<string>")(c)


def url_part(c: Column) -> Column:
    """Percent encoding of one path segment."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def slugify(name: Column) -> Column:
    """A name as a path: lower case, segments encoded, slashes kept."""
    return F.array_join(F.transform(F.split(F.lower(trim_all(name)), "/"), url_part), "/")


def unslug(path: Column) -> Column:
    """The name that a path gives back: segments decoded, joined by slashes, trimmed."""
    return trim_all(F.array_join(F.transform(F.split(path, "/"), lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))), "/"))


def addressable(name: Column) -> Column:
    """Can a path give this name back? No empty, dot or double-dot segment."""
    parts = F.split(F.lower(trim_all(name)), "/")
    return ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def header_key(c: Column) -> Column:
    """A table heading as letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def ecosystem_slug(c: Column) -> Column:
    """An ecosystem as a file name."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def html_escape(c: Column) -> Column:
    """The five signs that have a meaning in markup, the ampersand first."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def upper_snake(c: Column) -> Column:
    """camelCase as UPPER_SNAKE."""
    return F.upper(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))


def why_no_answer(name: Column) -> Column:
    """Why a name could not be resolved, by its look."""
    t = trim_all(name)
    return (
        F.when(F.length(t) < 2, "too short")
        .when(t.rlike(r"^[0-9a-fA-F]{32,}$"), "a digest")
        .when(~t.rlike("[A-Za-z]"), "no letters")
        .otherwise("not in the dictionary")
    )

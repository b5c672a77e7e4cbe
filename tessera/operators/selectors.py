"""Path selectors over documents: as one array expression each, or all of a pack as a trie.

:func:`nodes` yields an array of (path, node) in document order.  :class:`Trie` merges
selectors by their common steps up to each list that they spread over, so that a list
is spread once, whatever the number of selectors that go through it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values

_STEP = re.compile(r"\.(?P<key>[A-Za-z_][\w-]*)|\[(?P<every>\*)\]|\[\?\(@\.(?P<where>[\w-]+)\s*==\s*(?P<q>['\"])(?P<is>[^'\"]+)(?P=q)\)\]|\[(?P<at>\d+)\]")


@dataclass(frozen=True)
class Step:
    """One step: a key, every element, the elements with a value, or one element."""

    kind: str
    name: str = ""
    value: str = ""


def parse(selector: str) -> tuple[Step, ...]:
    """The steps after ``$``; a selector with anything else in it is refused."""
    if not selector.startswith("$"):
        raise ValueError(f"a selector starts with $: {selector}")
    at, steps = 1, []
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m:
            raise ValueError(f"cannot read {selector[at:]!r} in {selector}")
        at = m.end()
        if m["key"]:
            steps.append(Step("key", m["key"]))
        elif m["every"]:
            steps.append(Step("every"))
        elif m["where"]:
            steps.append(Step("where", m["where"], m["is"]))
        else:
            steps.append(Step("at", m["at"]))
    return tuple(steps)


def _pair(path: Column, node: Column) -> Column:
    return F.struct(path.alias("path"), node.alias("node"))


def _apply(found: Column, step: Step) -> Column:
    if step.kind == "key":
        went = F.transform(found, lambda n: _pair(F.concat(n["path"], F.lit(f".{step.name}")), values.child(n["node"], step.name)))
        return F.filter(went, lambda n: n["node"].isNotNull())
    if step.kind == "at":
        went = F.transform(found, lambda n: _pair(F.concat(n["path"], F.lit(f"[{step.name}]")), F.get(values.items(n["node"]), F.lit(int(step.name)))))
        return F.filter(went, lambda n: n["node"].isNotNull())
    spread = F.flatten(F.transform(found, lambda n: F.transform(values.items(n["node"]), lambda x, i: _pair(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), x))))
    if step.kind == "where":
        return F.filter(spread, lambda n: F.try_variant_get(values.child(n["node"], step.name), "$", "string") == step.value)
    return spread


def nodes(doc: Column, selector: str, *, root: str = "$") -> Column:
    """array of (path, node) that ``selector`` reaches in ``doc``, with concrete paths."""
    found = F.array(_pair(F.lit(root), doc))
    for step in parse(selector):
        found = _apply(found, step)
    return found


def matches(doc: Column, selector: str) -> Column:
    """The nodes alone."""
    return F.transform(nodes(doc, selector), lambda n: n["node"])


def literal(s: str) -> str:
    """A string as SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def child(v: str, key: str, kind: str = "variant") -> str:
    """SQL of a key's value: NULL if there is none, a null variant if it is null."""
    quoted = key.replace("'", "\\'")
    return f"try_variant_get({v}, {literal(f"$['{quoted}']")}, '{kind}')"


def items(v: str, steps: tuple[Step, ...] = ()) -> str:
    """SQL of the elements of the list that steps without a spread lead to, else of an empty array."""
    return f"coalesce(try_variant_get({v}, {literal(_path(steps))}, 'array<variant>'), array())"


def _path(steps: tuple[Step, ...]) -> str:
    """Steps without a spread as one path, so that no value on the way is built."""
    return "$" + "".join("['" + s.name.replace("'", "\\'") + "']" if s.kind == "key" else f"[{int(s.name)}]" for s in steps)


def _where(v: str, step: Step) -> str:
    return f"coalesce(try_variant_get({child(v, step.name)}, '$', 'string') = {literal(step.value)}, false)"


def walk(v: str, steps: tuple[Step, ...], kind: str = "variant") -> str:
    """SQL of the one value that steps without a spread lead to."""
    return f"try_variant_get({v}, {literal(_path(steps))}, '{kind}')" if steps else v


def keys(*names: str) -> tuple[Step, ...]:
    """Steps through keys alone."""
    return tuple(Step("key", name) for name in names)


def suffix(steps: tuple[Step, ...]) -> str:
    """Steps without a spread, as a path shows them."""
    return "".join(f".{s.name}" if s.kind == "key" else f"[{s.name}]" for s in steps)


def split(steps: tuple[Step, ...]) -> tuple[tuple[Step, ...], Step | None, tuple[Step, ...]]:
    """The steps before the first spread, the spread, and the steps after it."""
    for i, s in enumerate(steps):
        if s.kind in ("every", "where"):
            return steps[:i], s, steps[i + 1 :]
    return steps, None, ()


def any_of(v: str, steps: tuple[Step, ...], test=None, depth: int = 0) -> str:
    """SQL: does ``test`` (there at all, if none is given) hold for one of the values that ``steps`` reach from ``v``?"""
    before, spread, after = split(steps)
    x = f"x{depth}"
    if test is None and spread and spread.kind == "every" and after and all(s.kind in ("key", "every") for s in after):  # nothing but what the steps name is built
        return f"exists(coalesce(try_variant_get({v}, {literal(_path(before))}, {literal(f'array<{_shape(after)}>')}), array()), {x} -> {_there(x, after, depth)})"
    if spread is None:
        here = walk(v, before)
        return f"exists(array({here}), {x} -> {x} IS NOT NULL AND {test(x)})" if test else f"{here} IS NOT NULL"
    if test is None and spread.kind == "every" and not after:  # elements are counted, not built
        return f"coalesce(size(try_variant_get({v}, {literal(_path(before))}, 'array<struct<>>')) > 0, false)"
    inner = any_of(x, after, test, depth + 1)
    return f"exists({items(v, before)}, {x} -> {f'{_where(x, spread)} AND ' if spread.kind == 'where' else ''}{inner})"


def _shape(steps: tuple[Step, ...]) -> str:
    """The type of what steps reach, with nothing in it but what they name."""
    if not steps:
        return "variant"
    return f"array<{_shape(steps[1:])}>" if steps[0].kind == "every" else f"struct<`{steps[0].name}`:{_shape(steps[1:])}>"


def _there(v: str, steps: tuple[Step, ...], depth: int) -> str:
    """SQL: do steps reach anything from a value of their shape?"""
    before, spread, after = split(steps)
    here = v + "".join(f".`{s.name}`" for s in before)
    if spread is None:
        return f"{here} IS NOT NULL"
    return f"coalesce(exists({here}, x{depth + 1} -> {_there(f'x{depth + 1}', after, depth + 1)}), false)"


def reached(v: str, steps: tuple[Step, ...], depth: int = 0) -> str:
    """SQL of the array of values that ``steps`` reach from ``v``."""
    before, spread, after = split(steps)
    if spread is None:
        return f"array_compact(array({walk(v, before)}))"
    x = f"y{depth}"
    found = items(v, before)
    if spread.kind == "where":
        found = f"filter({found}, {x} -> {_where(x, spread)})"
    return f"flatten(transform({found}, {x} -> {reached(x, after, depth + 1)}))"


@dataclass
class Spread:
    """A list that selectors spread over: how it is reached from the node above, and its number among all."""

    tag: int
    kind: str
    above: int
    before: tuple[Step, ...]
    step: Step
    depth: int

    def rows(self, node: str, position: str) -> str:
        """SQL of the array of (tag, position, node) of the list's elements."""
        found = f"transform({items(node, self.before)}, (x, i) -> named_struct('tag', {self.tag}, 'position', concat({position}, array(i)), 'node', x))"
        return f"filter({found}, r -> {_where('r.node', self.step)})" if self.step.kind == "where" else found

    def here(self) -> str:
        """SQL: is a row one that this list can hang from?"""
        return f"tag = {self.above}" + (f" AND format <=> '{self.kind}'" if self.above == 0 else "")


@dataclass
class Trie:
    """The selectors of all formats of a pack; tag 0 is the document itself."""

    spreads: list[Spread] = field(default_factory=list)
    _known: dict = field(default_factory=dict)

    def add(self, kind: str, selector: str) -> tuple[int, tuple[Step, ...]]:
        """The tag of the list that a selector spreads over last, and its steps from an element of that."""
        tag, steps, depth = 0, parse(selector), 0
        while True:
            before, spread, after = split(steps)
            if spread is None:
                return tag, before
            depth += 1
            key = (kind, tag, before, spread)
            if key not in self._known:
                self._known[key] = len(self.spreads) + 1
                self.spreads.append(Spread(self._known[key], kind, tag, before, spread, depth))
            tag, steps = self._known[key], after

    def path(self, tag: int, position: str) -> str:
        """SQL of the path of a node: its place says the rest, so that only nodes that are shown get one."""
        parts: list[str] = []
        while tag:
            s = self.spreads[tag - 1]
            parts = [literal(suffix(s.before) + "["), f"{position}[{s.depth - 1}]", "']'", *parts]
            tag = s.above
        return f"concat('$', {', '.join(parts)})" if parts else "'$'"

    def levels(self) -> list[list[Spread]]:
        """Lists of the document, lists of their elements, and so on."""
        deepest = max((s.depth for s in self.spreads), default=0)
        return [[s for s in self.spreads if s.depth == d] for d in range(1, deepest + 1)]

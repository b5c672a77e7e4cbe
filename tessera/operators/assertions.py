"""Assertions on a node, compiled to the SQL of one boolean expression. True means no finding.

SQL text is made on the driver without asking Spark for every part of it, so that a
pack of many rules is compiled in one call a rule.
"""

from __future__ import annotations

from itertools import count

from . import selectors
from .selectors import child, items, literal

_names = count()


def let(value: str, body) -> str:
    """``body`` of a value that is worked out once."""
    x = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


class Facts:
    """What assertions ask for that is worked out before them, each once for all rules.

    ``known``: booleans about the whole document, worked out where the document is and
    carried to its nodes.  ``texts``: values that keys of nodes lead to, as text.
    """

    def __init__(self, doc: str = "doc") -> None:
        self.doc, self.known, self.texts = doc, {}, {}

    def ask(self, expression: str) -> str:
        """The column that will hold ``expression``, which is over the document."""
        return self.known.setdefault(expression, f"__fact_{len(self.known)}")

    def text(self, node: str, keys: tuple[str, ...]) -> str:
        """The column that will hold the value that keys of objects lead to, as text; NULL for a null and if there is none."""
        return self.texts.setdefault((node, keys), f"__text_{len(self.texts)}")

    def levels(self) -> list[list[tuple[str, str]]]:
        """(SQL, name) of what is worked out beside the nodes."""
        return [[(selectors.walk(node, selectors.keys(*keys), "string"), name) for (node, keys), name in self.texts.items()]] if self.texts else []


def is_list(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'array<struct<>>') IS NOT NULL)"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'struct<>') IS NOT NULL)"


# White space around nothing, or around what the upper case of is NOASSERTION (ß becomes SS, ſ S and ı I): one look instead of trimming.
_BLANK = r"^[\s ﻿]*(?:[nN][oO][aA](?:[sSſ]{2}|ß)[eE][rR][tT][iIı][oO][nN])?[\s ﻿]*\z"


def truthy(v: str) -> str:
    """Does a value count as present? As :func:`tessera.functions.values.truthy`; ``v`` should be cheap to repeat."""
    return (
        f"(CASE WHEN {v} IS NULL THEN false WHEN {is_list(v)} THEN size(try_variant_get({v}, '$', 'array<struct<>>')) > 0"
        f" WHEN {is_object(v)} THEN size(try_variant_get({v}, '$', 'map<string,struct<>>')) > 0"
        f" ELSE (CASE schema_of_variant({v}) WHEN 'VOID' THEN false WHEN 'STRING' THEN NOT regexp_like(try_variant_get({v}, '$', 'string'), {literal(_BLANK)}) ELSE true END) END)"
    )


def text(v: str) -> str:
    """The string of a variant that is a string, else NULL."""
    return f"(CASE WHEN {v} IS NULL OR {is_list(v)} OR {is_object(v)} THEN NULL WHEN schema_of_variant({v}) = 'STRING' THEN try_variant_get({v}, '$', 'string') END)"


def _follow(v: str, key: str) -> str:
    """A key of an object, or the list of that key's values over the objects of a list; NULL if there is none."""
    spread = f"filter(transform({items(v)}, x -> {child('x', key)}), x -> x IS NOT NULL)"
    listed = let(spread, lambda s: f"CASE WHEN size({s}) > 0 THEN to_variant_object({s}) END")
    return f"coalesce({child(v, key)}, CASE WHEN {is_list(v)} THEN {listed} END)"


def _followed(v: str, keys: tuple[str, ...], body) -> str:
    """``body`` of the value that keys lead to, through lists too."""
    return let(_follow(v, keys[0]), lambda x: _followed(x, keys[1:], body)) if keys else body(v)


def present(node: str, keys: tuple[str, ...], facts: Facts) -> str:
    """Do keys lead to a value that says something?

    Its text decides, in one look: only a blank one, and one that an empty container or a
    string may have, ask for the value itself, and lists are followed only where one is.
    """
    said, value = facts.text(node, keys), selectors.walk(node, selectors.keys(*keys))
    unclear = f"{said} IN ('[]', '{{}}') OR regexp_like({said}, {literal(_BLANK)})"
    lists = " OR ".join(is_list(selectors.walk(node, selectors.keys(*keys[:i]))) for i in range(len(keys)))
    return f"(CASE WHEN {said} IS NOT NULL THEN (CASE WHEN {unclear} THEN {let(value, truthy)} ELSE true END) WHEN {lists} THEN {_followed(node, keys, truthy)} ELSE false END)"


def exists(node: str, expression: str, facts: Facts) -> str:
    """Is one of the alternatives (``a.b|c``) present with a value that says something?"""
    out = []
    for alternative in expression.split("|"):
        plain = alternative.replace("$.", "", 1)
        keys = tuple(plain.split("."))
        at = next((i for i, key in enumerate(keys) if "[" in key), None)
        if at is None:
            out.append(present(node, keys, facts))
        else:
            out.append(_followed(node, keys[:at], lambda v, plain=plain: selectors.any_of(v, selectors.parse(f"$.{plain}"), truthy)))
    return f"({' OR '.join(out)})"


def property_named(node: str, where: str, suffix: str) -> str:
    """Does a list of properties have one whose name ends in ``suffix``, with a value that says something?"""
    value = node
    for key in where.split("."):
        value = child(value, key)
    name, said = let(child("p", "name"), text), let(child("p", "value"), truthy)
    return f"exists({items(value)}, p -> coalesce(endswith({name}, {literal(suffix)}), false) AND {said})"


def _equal(node: str, key: str, want: object) -> str:
    """Is a key's value, as text, that of ``want``, whatever the case? null is None."""
    wanted = "none" if want is None else str(want).lower()
    v = child(node, key)
    said = f"coalesce({child(node, key, 'string')}, CASE WHEN is_variant_null({v}) THEN 'None' ELSE to_json({v}) END)"
    return f"lower(coalesce({said}, '')) = {literal(wanted)}"


def holds(assertion: dict, node: str, facts: Facts) -> str:
    """The SQL of an assertion tree over ``node``, a column or variable."""
    if parts := assertion.get("allOf"):
        return f"({' AND '.join(holds(p, node, facts) for p in parts)})"
    if parts := assertion.get("anyOf"):
        return f"({' OR '.join(holds(p, node, facts) for p in parts)})"
    if inner := assertion.get("not"):
        return f"(NOT {holds(inner, node, facts)})"
    if (wanted := assertion.get("exists")) is not None:
        out = exists(node, wanted, facts)
        if wanted.startswith("$"):
            out = f"({out} OR {facts.ask(selectors.any_of(facts.doc, selectors.parse(wanted.split('|')[0]), truthy))})"
        return out
    if named := assertion.get("_property"):
        return property_named(node, *named)
    if (pattern := assertion.get("matches")) is not None:
        members = f"coalesce(map_values(try_variant_get({node}, '$', 'map<string,variant>')), array())"
        fits = lambda v: f"coalesce(regexp_like(try_variant_get({v}, '$', 'string'), {literal(pattern)}) AND {text(v)} IS NOT NULL, false)"
        return f"(exists({members}, m -> {fits('m')}) OR {fits(node)})"
    if (pairs := assertion.get("equals")) is not None:
        return f"(({' OR '.join(_equal(node, k, w) for k, w in pairs.items()) or 'false'}) AND {is_object(node)})"
    if (rule := assertion.get("minLength")) is not None:
        out = []
        for alternative in rule.get("field", "").split("|"):
            steps = selectors.parse(alternative if alternative.startswith("$") else f"$.{alternative}")
            first = f"try_element_at({selectors.reached(facts.doc, steps)}, 1)"
            out.append(facts.ask(f"coalesce(size(try_variant_get({first}, '$', 'array<variant>')) >= {int(rule.get('min', 1))}, false)"))
        return f"({' OR '.join(out)})"
    return "true"

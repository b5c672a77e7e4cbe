"""Identifier coverage over component trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values
from . import detect
from .assertions import text
from .selectors import child, items, literal

ELEMENTS = ("purl", "cpe", "supplier", "version", "license", "hash")


# White space around nothing or around a text that says nothing, as written.
_EMPTY = r"^[\s ﻿]*(?:NOASSERTION\.?|NONE)?[\s ﻿]*\z"

#: Levels that a document can have: parsed JSON nests at most 1,000 deep, a level takes two.
MOST_LEVELS = 500


def _children(parent: Column, path: Column, level: Column) -> Column:
    """array of (level, path, component) of the objects in a component list."""
    each = F.transform(values.items(values.child(parent, "components")), lambda c, i: F.struct(level.alias("level"), F.concat(path, F.lit(".components["), i.cast("string"), F.lit("]")).alias("path"), c.alias("component")))
    return F.filter(each, lambda c: values.is_object(c["component"]))


def _tree(doc: Column) -> Column:
    """All components of a document, level by level; the loop is within the row and idle where nothing is nested."""

    def deeper(state: Column, level: Column) -> Column:
        more = F.flatten(F.transform(state["last"], lambda c: _children(c["component"], c["path"], level)))
        return F.when(F.size(state["last"]) == 0, state).otherwise(values.let(more, lambda m: F.struct(F.concat(state["all"], m).alias("all"), m.alias("last"))))

    def walk(top: Column) -> Column:
        nested = F.exists(top, lambda c: values.child(c["component"], "components").isNotNull())
        levels = F.when(nested, F.sequence(F.lit(1), F.lit(MOST_LEVELS))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, F.struct(top.alias("all"), top.alias("last")), deeper)["all"]

    return values.let(_children(doc, F.lit("$"), F.lit(0)), walk)


def component_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, level, path, component VARIANT) of every component, nested ones included.

    ``docs`` has doc_id and doc (VARIANT) of the nested format.  A document is walked in
    its own row, so the number of components in all has no limit and nothing is shuffled.
    """
    return docs.select("doc_id", F.inline(_tree(F.col("doc"))))


def components_from(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, name, version, purl, declared) of every component or package, with the advisories that its document declares for it.

    A document with a component list or a bomFormat is read as nested even if it also
    has packages; a missing name is empty.
    """
    doc, v = F.col("doc"), F.col("node")
    nested = F.coalesce(values.child(doc, "components").isNotNull() | values.truthy(values.child(doc, "bomFormat")), F.lit(False))
    node = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("node"))
    tree = F.transform(_tree(doc), lambda c: node("component", c["component"]))
    packages = F.transform(F.filter(values.items(values.child(doc, "packages")), values.is_object), lambda p: node("package", p))
    stated = F.transform(values.items(values.child(doc, "vulnerabilities")), lambda x: node("declared", x))
    # Documents are read once: what they declare are rows beside those of their components. The outer forms keep filters
    # from being added that would work lists out once more.
    rows = docs.select("doc_id", F.concat(F.when(nested, tree).otherwise(packages), stated).alias("__rows")).select("doc_id", F.inline_outer("__rows"))

    said = lambda c, p: F.expr(f"CASE kind WHEN 'component' THEN {detect.said('node', c)} WHEN 'package' THEN {detect.said('node', p)} END")
    text_of = lambda x, key: values.text(values.child(x, key))
    located = F.get(F.filter(values.items(values.child(v, "externalRefs")), lambda r: text_of(r, "referenceType") == "purl"), F.lit(0))
    purl = F.when(F.col("kind") == "component", F.expr(detect.said("node", "purl"))).when(F.col("kind") == "package", text_of(located, "referenceLocator"))
    declares = (F.col("kind") == "declared") & F.col("doc_id").isNotNull()
    several = lambda key, of: F.filter(F.transform(values.items(values.child(v, key)), lambda r: text_of(r, of)), lambda x: x.isNotNull())
    ids = F.filter(F.concat(F.array(text_of(v, "id")), several("references", "id")), lambda x: x.isNotNull() & (x != ""))
    affected = values.let(several("affects", "ref"), lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit(""))))
    refs = F.when(declares, affected).otherwise(F.array(said("bom-ref", "SPDXID")))
    rows = rows.select("doc_id", "kind", said("name", "name").alias("name"), said("version", "versionInfo").alias("version"), purl.alias("purl"), F.when(declares, ids).alias("ids"), F.explode_outer(refs).alias("ref"))
    own = F.flatten(F.collect_list("ids").over(Window.partitionBy("doc_id", "ref")))
    whole = F.flatten(F.collect_list(F.when(F.col("ref") == "", F.col("ids"))).over(Window.partitionBy("doc_id")))
    rows = rows.withColumns({"__own": own, "__whole": whole}).where("kind <> 'declared'")
    return rows.select("doc_id", "ref", F.coalesce("name", F.lit("")).alias("name"), "version", "purl", F.array_distinct(F.concat("__own", "__whole")).alias("declared"))


def _clean(s: str) -> str:
    """SQL of :func:`tessera.functions.values.clean`."""
    return f"coalesce(NOT regexp_like({s}, {literal(_EMPTY)}), false)"


def _said(v: str, *keys: str) -> str:
    """SQL: does a key, reached by keys, hold a string that says something? Without a lambda, so that it is generated code."""
    for key in keys[:-1]:
        v = child(v, key)
    return _clean(text(child(v, keys[-1])))


def _any(v: str, key: str, test) -> str:
    """SQL: does ``test`` hold for an element of a key's list? No list is built where there is no such key."""
    return f"(CASE WHEN {child(v, key)} IS NULL THEN false ELSE exists({items(child(v, key))}, x -> {test('x')}) END)"


def nested_elements(c: str) -> dict[str, Column]:
    """Does a component of the nested format state each element?"""
    licence = lambda x: _clean(f"coalesce({text(child(x, 'expression'))}, {text(child(child(x, 'license'), 'id'))}, {text(child(child(x, 'license'), 'name'))})")
    found = {
        "purl": _said(c, "purl"),
        "cpe": _said(c, "cpe"),
        "supplier": f"({_said(c, 'publisher')} OR {_said(c, 'supplier', 'name')})",
        "version": _said(c, "version"),
        "license": _any(c, "licenses", licence),
        "hash": _any(c, "hashes", lambda h: _said(h, "content")),
    }
    return {k: F.expr(v) for k, v in found.items()}


def flat_elements(p: str) -> dict[str, Column]:
    """Does a package of the flat format state each element?"""
    of = lambda test: _any(p, "externalRefs", lambda r: f"({test(text(child(r, 'referenceType')))} AND {_said(r, 'referenceLocator')})")
    found = {
        "purl": of(lambda t: f"{t} = 'purl'"),
        "cpe": of(lambda t: f"startswith({t}, 'cpe')"),
        "supplier": f"({_said(p, 'supplier')} OR {_said(p, 'originator')})",
        "version": _said(p, "versionInfo"),
        "license": f"({_said(p, 'licenseConcluded')} OR {_said(p, 'licenseDeclared')})",
        "hash": _any(p, "checksums", lambda h: _said(h, "checksumValue")),
    }
    return {k: F.expr(v) for k, v in found.items()}


def coverage(docs: DataFrame) -> DataFrame:
    """Per document: total, top_level, identified, a count for each element, and two flags.

    ``docs`` has doc_id, one row each, and doc (VARIANT).  A document with a component
    list or a bomFormat is read as nested even if it also has packages; one without
    components counts zeros.  Documents are read once, and their components counted
    where the documents are if those are dealt out by doc_id.
    """
    doc = F.col("doc")
    nested = F.coalesce(doc.isNotNull() & (values.child(doc, "components").isNotNull() | values.truthy(values.child(doc, "bomFormat"))), F.lit(False))
    node = lambda top, v: F.struct(top.alias("top"), v.alias("node"))
    packages = F.filter(values.items(values.child(doc, "packages")), values.is_object)
    listed = F.when(F.col("__nested"), F.transform(_tree(doc), lambda c: node(c["level"] == 0, c["component"]))).otherwise(F.transform(packages, lambda p: node(F.lit(True), p)))
    has = lambda k: F.size(values.items(values.child(doc, k))) > 0
    carried = ["doc_id", "__nested", "dependencies", "compositions"]
    rows = docs.select("doc_id", "doc", nested.alias("__nested"), (has("dependencies") | has("relationships")).alias("dependencies"), has("compositions").alias("compositions"))
    rows = rows.select(*carried, listed.alias("__rows")).select(*carried, F.inline_outer("__rows"))
    flat = flat_elements("node")
    rows = rows.select(*carried, "top", *[F.when(F.col("__nested"), v).otherwise(flat[k]).alias(k) for k, v in nested_elements("node").items()])
    counts = {"total": F.count("top"), "top_level": F.count_if("top"), "identified": F.count_if(F.col("purl") | F.col("cpe")), **{k: F.count_if(k) for k in ELEMENTS}}
    return rows.groupBy("doc_id").agg(*[F.bool_or(k).alias(k) for k in carried[2:]], *[v.alias(k) for k, v in counts.items()])


def distinct_tools(entries: DataFrame) -> DataFrame:
    """One row: documents in all, those that name the tool that made them, and how many different tools (AGG of non-blank values as written)."""
    said = F.when(F.trim("tool") != "", F.col("tool"))
    return entries.agg(F.count("*").alias("documents"), F.count(said).alias("with_tool"), F.count_distinct(said).alias("tools"))


def gaps(entries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, supplied, declared, silent): is a field there, stated as unknown with a reason in ``<field>Unknown``, or neither?"""
    there = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    sums = entries.agg(*[F.array(F.count_if(there(f)), F.count_if(~there(f) & there(f"{f}Unknown")), F.count_if(~there(f) & ~there(f"{f}Unknown"))).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)[0].alias("supplied"), F.col(f)[1].alias("declared"), F.col(f)[2].alias("silent")) for f in fields])
    return sums.select(F.inline(rows))


def element_scores(sections: DataFrame) -> DataFrame:
    """(doc_id, element, required, n, zero): compliance sections of a document by element, how many, and how many scored nothing.

    ``sections``: doc_id, section_id, section_data_field, required, score.
    """
    element = F.concat_ws(" ", F.col("section_id").cast("string"), F.col("section_data_field").cast("string"))
    return sections.groupBy("doc_id", element.alias("element")).agg(F.bool_or("required").alias("required"), F.count("*").alias("n"), F.count_if(F.coalesce("score", F.lit(0)) == 0).alias("zero"))


def summary(per_document: DataFrame) -> DataFrame:
    """Totals over all documents, with shares in percent to one decimal."""
    sums = per_document.agg(F.count("*").alias("documents"), F.count_if("dependencies").alias("with_dependencies"), F.count_if("compositions").alias("with_compositions"), *[F.sum(k).alias(k) for k in ("total", "identified", *ELEMENTS)])
    return sums.select("*", *[F.round(F.try_divide(F.col(k) * 100.0, "total"), 1).alias(f"{k}_percent") for k in ("identified", *ELEMENTS)])

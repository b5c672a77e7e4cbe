"""Which format and version a document is in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values, versions
from .selectors import child, literal

_PROFILE = r"^(software_|simplelicensing_|security_|build_|ai_|dataset_)"


def element_type(e: Column) -> Column:
    """The type of a graph element without profile, address and case; empty if it has none."""
    raw = F.coalesce(values.text(values.child(e, "type")), values.text(values.child(e, "@type")), F.lit(""))
    return F.lower(F.regexp_replace(F.element_at(F.split(raw, "[#/]"), -1), _PROFILE, ""))


def said(v: str, *keys: str) -> str:
    """SQL of the first of some keys of a column that is a string; without a lambda, so that all of it is generated code."""
    one = lambda k: f"CASE WHEN schema_of_variant({child(v, k)}) = 'STRING' THEN {child(v, k, 'string')} END"
    return f"coalesce({', '.join(map(one, keys))})"


def type_of(e: str) -> str:
    """SQL of :func:`element_type`."""
    last = f"regexp_replace(coalesce({said(e, 'type', '@type')}, ''), '(?s)^.*[#/]', '')"
    return f"lower(regexp_replace({last}, {literal(_PROFILE)}, ''))"


def elements(doc: Column) -> Column:
    """The elements of a graph document; a typed document without a graph is its own element."""
    graph = values.child(doc, "@graph")
    listed = F.filter(values.items(graph), values.is_object)
    alone = F.when(element_type(doc) != "", F.array(doc)).otherwise(F.array().cast("array<variant>"))
    return F.when(values.is_list(graph), listed).otherwise(alone)


def _context(doc: Column) -> Column:
    context = values.child(doc, "@context")
    return F.coalesce(values.text(context), F.to_json(context), F.lit(""))


def is_graph(doc: Column) -> Column:
    """Is it a document of the graph format (SPDX 3)? By its context, else by its typed elements."""
    kinds = ("creationinfo", "spdxdocument", "package", "sbom")
    graph = values.child(doc, "@graph")
    listed = F.exists(F.filter(values.items(graph), values.is_object), lambda e: element_type(e).isin(*kinds))
    alone = (_said(doc, "type").isNotNull() | _said(doc, "@type").isNotNull()) & element_type(doc).isin(*kinds)
    typed = F.when(values.is_list(graph), listed).otherwise(alone)
    context = values.child(doc, "@context").isNotNull() & _context(doc).rlike(r"spdx\.org/rdf/3\.")
    return F.coalesce(context | (_said(doc, "spdxVersion").isNull() & typed), F.lit(False))


def _said(doc: Column, key: str) -> Column:
    """The string of a key of a document; without a lambda, so that it is generated code."""
    v = values.child(doc, key)
    return F.when(~values.is_list(v) & ~values.is_object(v) & (F.schema_of_variant(v) == "STRING"), F.try_variant_get(v, "$", "string"))


def graph_version(doc: Column) -> Column:
    """Stated by the creation info, else by the context, else unknown."""
    version = lambda e: values.text(values.child(e, "specVersion"))
    # Few elements have a version, so their type is asked for last.
    stated = F.transform(F.filter(elements(doc), lambda e: values.child(e, "specVersion").isNotNull() & (version(e) != "") & (element_type(e) == "creationinfo")), version)
    by_context = F.regexp_extract(_context(doc), r"spdx\.org/rdf/(\d+\.\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.get(stated, F.lit(0)), F.nullif(by_context, F.lit("")), F.lit("unknown"))


def detect(doc: Column) -> Column:
    """struct(format, spec, supported, problem): ``problem`` says why there is no format."""
    stated = _said(doc, "spdxVersion")
    spec = F.coalesce(_said(doc, "specVersion"), F.lit("unknown"))
    has = lambda k: values.child(doc, k).isNotNull()

    def answer(kind: str | None, version: Column, problem: str | None = None, known: bool = True) -> Column:
        read = versions.supported(F.lit(kind), version) if kind and known else F.lit(False)
        return F.struct(F.lit(kind).cast("string").alias("format"), version.alias("spec"), read.alias("supported"), F.lit(problem).cast("string").alias("problem"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(doc.isNull(), answer(None, nothing, "not JSON"))
        .when(~values.is_object(doc), answer(None, nothing, "not an object"))
        .when(stated.isNotNull(), answer("spdx", F.regexp_replace(stated, "^SPDX-", "")))
        .when(is_graph(doc), answer("spdx", graph_version(doc)))
        .when(has("SPDXID"), answer("spdx", F.lit("unknown"), known=False))
        .when((_said(doc, "bomFormat") == "CycloneDX") | has("components"), answer("cyclonedx", spec))
        .otherwise(answer(None, nothing, "format not detected"))
    )


def is_draft(doc: Column) -> Column:
    """Is the document marked as a draft in its metadata properties?"""
    metadata = values.child(doc, "metadata")
    return F.coalesce(F.exists(values.items(values.child(metadata, "properties")), lambda p: F.endswith(values.text(values.child(p, "name")), F.lit("draft")) & (F.lower(values.text(values.child(p, "value"))) == "true")), F.lit(False))

"""Graph documents (SPDX 3) as the flat 2.x shape that rules read, by tables of elements and edges.

Every element of every document is a row, and so is every reference that an element
makes.  References and elements of an id stand together in a window over the document,
where the last element of an id wins; licences and annotations reach packages by a group
of the same key.  All of it asks for rows of a document in one partition and no more, so
documents that are dealt out by doc_id are shuffled no further.  Only the finished
packages, relations and notes of a document come together in its row.
What the conversion does not use is counted, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, values
from .assertions import text as whole_text
from .detect import elements, graph_version, said, type_of
from .selectors import child

PACKAGES = ("package", "file", "snippet")
RELATIONS = ("relationship", "lifecyclescopedrelationship")
AGENTS = ("agent", "person", "organization", "softwareagent", "tool")
DOCUMENTS = ("spdxdocument", "sbom", "bom")
# Types that are reached through others, and the package keys that are read.
REACHED = ("licenseexpression", "anylicenseinfo", "customlicense", "listedlicense", "noassertionlicense", "nonelicense", "hash", "packageverificationcode", "externalmap", "namespacemap", "positivintegerrange", "")
READ_KEYS = (
    "type", "@type", "spdxId", "@id", "creationInfo", "name",
    "summary", "description", "software_packageVersion", "packageVersion", "software_packageUrl", "packageUrl",
    "suppliedBy", "originatedBy", "builtBy", "verifiedUsing", "externalIdentifier", "externalRef",
    "software_additionalPurpose", "software_primaryPurpose", "software_downloadLocation", "software_homePage", "software_copyrightText", "comment",
    "extension",
)



LICENCES = ("hasdeclaredlicense", "hasconcludedlicense")
# The keys by which elements refer to others.
_REFERENCES = {
    PACKAGES: ("suppliedBy", "originatedBy", "builtBy", "verifiedUsing", "externalIdentifier"),
    ("creationinfo",): ("createdBy", "createdUsing"),
    DOCUMENTS: ("namespaceMap", "import"),
}
_REF = "array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>"


def _said(v: str, *keys: str) -> Column:
    """The first of some keys of a column that is a string."""
    return F.expr(said(v, *keys))


def _filled(v: str, *keys: str) -> Column:
    return F.nullif(_said(v, *keys), F.lit(""))


def _list(v: Column) -> Column:
    """A list as it is; anything else that is there as a list of one."""
    none = F.array().cast("array<variant>")
    return values.let(v, lambda x: F.when(x.isNull() | values.is_null(x), none).otherwise(F.coalesce(values.listed(x), F.array(x))))


def _identity(e: str) -> Column:
    return _said(e, "spdxId", "@id")


def _facts(e: str, kind: Column) -> Column:
    """What others can want to know of an element that they refer to."""
    return F.struct(
        kind.alias("kind"),
        _said(e, "name").alias("name"),
        _said(e, "simplelicensing_licenseExpression", "licenseExpression", "name").alias("licence"),
        _said(e, "algorithm").alias("algorithm"),
        _filled(e, "hashValue").alias("hash"),
        F.lower(F.coalesce(_said(e, "externalIdentifierType"), F.lit(""))).alias("scheme"),
        _filled(e, "identifier").alias("identifier"),
        _said(e, "namespace").alias("namespace"),
        _filled(e, "externalSpdxId").alias("external"),
    )


def _own(e: str, kind: Column) -> Column:
    """What an element says of itself in the flat view; keys that its kind has no use for are not looked up."""
    keys = F.map_keys(F.try_variant_get(F.col(e), "$", "map<string,variant>"))
    of = lambda kinds, c: F.when(kind.isin(*kinds), c)
    return F.struct(
        _identity(e).alias("id"),
        of(PACKAGES + DOCUMENTS, _filled(e, "name")).alias("name"),
        of(PACKAGES, _filled(e, "software_packageVersion", "packageVersion")).alias("version"),
        of(PACKAGES, _filled(e, "software_packageUrl", "packageUrl")).alias("purl"),
        of(PACKAGES, _filled(e, "software_downloadLocation")).alias("location"),
        of(PACKAGES, _filled(e, "software_copyrightText")).alias("copyright"),
        of((*PACKAGES, "creationinfo"), _filled(e, "comment")).alias("comment"),
        of(("creationinfo",), _filled(e, "created")).alias("created"),
        of(RELATIONS, _said(e, "from")).alias("from"),
        of(RELATIONS, values.text(F.get(_list(values.child(F.col(e), "to")), F.lit(0)))).alias("to"),
        of(RELATIONS, _said(e, "relationshipType")).alias("type"),
        of(("annotation",), F.upper(F.coalesce(_said(e, "annotationType"), F.lit("OTHER")))).alias("note"),
        of(("annotation",), F.coalesce(_said(e, "statement", "comment"), F.lit(""))).alias("statement"),
        of(("annotation",), F.array_distinct(F.transform(_list(values.child(F.col(e), "subject")), values.text))).alias("subjects"),
        of(PACKAGES, F.filter(keys, lambda k: ~k.isin(*READ_KEYS))).alias("unread"),
    )


def _is_licence(own: Column) -> Column:
    return F.coalesce(F.lower(own["type"]).isin(*LICENCES), F.lit(False))


def elements_and_edges(docs: DataFrame) -> DataFrame:
    """A row for each element (``role`` self) and for each reference that it makes.

    doc_id, at (the element's place), kind, role, pos, ref (the id referred to), facts
    (of the element itself, or of one that stands where a reference could), own (of
    the element itself) and about (the document's version and ``docs``' other columns, on
    its first element).  ``docs`` has doc_id, one row each, and doc.  A document without
    elements has one row, of no element.
    """
    about = F.struct(graph_version(F.col("doc")).alias("version"), *[c for c in docs.columns if c not in ("doc_id", "doc")])
    each = docs.select("doc_id", about.alias("about"), elements(F.col("doc")).alias("all")).select("doc_id", "about", F.posexplode_outer("all").alias("at", "e"))
    each = each.select("doc_id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("about")).alias("about"), "at", "e", F.expr(type_of("e")).alias("kind"))
    e, kind = F.col("e"), F.col("kind")
    row = lambda role, pos, v: F.struct(F.lit(role).alias("role"), pos.alias("pos"), v.alias("v"))
    of = lambda key, role: F.transform(_list(values.child(e, key)), lambda v, i: row(role, i, v))
    none = F.array().cast("array<struct<role:string,pos:int,v:variant>>")
    made = none
    for kinds, keys in _REFERENCES.items():
        made = F.when(kind.isin(*kinds), F.concat(*[of(k, k) for k in keys])).otherwise(made)
    made = F.when(kind.isin(*RELATIONS) & F.lower(_said("e", "relationshipType")).isin(*LICENCES), of("to", "licence")).otherwise(made)
    rows = each.select("doc_id", "about", "at", "kind", F.explode(F.concat(F.array(row("self", F.lit(0), e)), made)).alias("r")).select("doc_id", "about", "at", "kind", "r.*")
    own, whole = F.col("role") == "self", F.expr("try_variant_get(v, '$', 'struct<>') IS NOT NULL")
    return rows.select(
        "doc_id", F.when(own, F.col("about")).alias("about"), "at", "kind", "role", "pos",
        F.when(~whole, F.expr(whole_text("v"))).alias("ref"),
        F.when(whole, _facts("v", F.when(own, F.col("kind")).otherwise(F.expr(type_of("v"))))).alias("facts"),
        F.when(own, _own("v", F.col("kind"))).alias("own"),
    )


def resolved(rows: DataFrame) -> DataFrame:
    """The rows with the facts of what they refer to; of equal ids in a document the last element's.

    A reference that leads nowhere keeps no facts.
    """
    key = F.coalesce("ref", "own.id")
    peers = Window.partitionBy("doc_id").orderBy("__key").rangeBetween(Window.currentRow, Window.currentRow)
    named = F.col("own.id").isNotNull()
    known = F.max_by(F.when(named, F.col("facts")), F.when(named, F.col("at"))).over(peers)
    met = rows.withColumn("__key", key).withColumn("__facts", known)
    facts = F.when(F.col("role") != "self", F.coalesce("facts", F.when(F.col("ref").isNotNull(), F.col("__facts"))))
    return met.withColumn("facts", facts).drop("__key", "__facts")


def _agent(x: Column) -> Column:
    """Display name of an agent; an id that leads nowhere stands for itself."""
    kind = x["facts"]["kind"]
    title = F.when(kind == "organization", "Organization: ").when(kind == "person", "Person: ").when(kind.isin("tool", "softwareagent"), "Tool: ").otherwise("")
    return F.when(x["facts"].isNull(), x["ref"]).otherwise(F.concat(title, x["facts"]["name"]))


def _licence(x: Column) -> Column:
    f = x["facts"]
    return F.when(f.isNull(), x["ref"]).otherwise(F.coalesce(f["licence"], F.when(f["kind"] == "noassertionlicense", "NOASSERTION"), F.when(f["kind"] == "nonelicense", "NONE")))


def _checksum(x: Column) -> Column:
    f = x["facts"]
    algorithm = F.coalesce(F.regexp_replace(F.upper(f["algorithm"]), "[^A-Z0-9]", ""), F.lit("NOASSERTION"))
    return F.when((f["kind"] == "hash") & f["hash"].isNotNull(), F.struct(algorithm.alias("algorithm"), f["hash"].alias("checksumValue")))


def _reference(category: Column, kind: Column, locator: Column) -> Column:
    return F.struct(category.alias("referenceCategory"), kind.alias("referenceType"), locator.alias("referenceLocator"))


def _identifier(x: Column, purl: Column) -> Column:
    f = x["facts"]
    scheme = f["scheme"]
    kind = F.when(scheme == "packageurl", "purl").when(scheme == "", "other").otherwise(scheme)
    category = F.when(scheme.isin("cpe22", "cpe23"), "SECURITY").otherwise("OTHER")
    return F.when(f["identifier"].isNotNull() & ~((scheme == "packageurl") & purl.isNotNull()), _reference(category, kind, f["identifier"]))


def _known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _some(a: Column) -> Column:
    """A list, or NULL (so that it is left out) if it is empty."""
    return F.when(F.size(a) > 0, a)


def _role(role: str, made) -> Column:
    """What the references of a role come to, in order."""
    return _known(F.transform(F.filter("refs", lambda x: x["role"] == role), made))


def _first(options: Column) -> Column:
    """The first element that is neither NULL nor empty."""
    return F.get(F.filter(options, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _note(x: Column) -> Column:
    return F.struct(x["annotationType"].alias("annotationType"), x["comment"].alias("comment"))


def parts(rows: DataFrame) -> DataFrame:
    """doc_id, at, kind, own and about of every element, with its references in order (``refs``) and what relations and annotations say of it.

    declared, concluded (the last licence of each kind) and notes come to an element by
    its id: elements and what is said of an id are one group, from which the elements
    are spread again, so that nothing is worked out twice.
    """
    refs = F.when(F.col("role") != "self", F.struct("role", "pos", "facts", "ref"))
    whole = rows.groupBy("doc_id", "at").agg(F.first("kind").alias("kind"), F.first("own", ignorenulls=True).alias("own"), F.first("about", ignorenulls=True).alias("about"), F.array_sort(F.collect_list(refs)).alias("refs"))
    texts = _role("licence", _licence)
    text = F.get(F.reverse(F.filter(texts, lambda t: t != "")), F.lit(0))
    licence = _is_licence(F.col("own"))
    ids = F.coalesce("own.subjects", F.when(licence, F.array("own.from")), F.array().cast("array<string>"))
    note = F.when(F.col("own.subjects").isNotNull(), F.struct("at", F.col("own.note").alias("annotationType"), F.col("own.statement").alias("comment")))
    said_of = F.struct("at", F.when(licence, F.lower("own.type")).alias("kind"), F.when(licence, text).alias("text"), note.alias("note"))
    part = F.struct("at", "kind", "own", "about", "refs")
    told = whole.select("doc_id", part.alias("part"), said_of.alias("of"), ids.alias("ids"))
    told = told.select("doc_id", "part", "of", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("own"), F.col("part.own.id").alias("id"))), F.transform(F.array_compact("ids"), lambda i: F.struct(F.lit(False).alias("own"), i.alias("id"))))).alias("r"))
    told = told.select("doc_id", F.col("r.id").alias("id"), F.when(F.col("r.own"), F.col("part")).alias("part"), F.when(~F.col("r.own"), F.col("of")).alias("of"))
    last = lambda k: F.max_by("of.text", F.when((F.col("of.kind") == k) & F.col("of.text").isNotNull(), F.col("of.at")))
    by = told.groupBy("doc_id", "id").agg(F.collect_list("part").alias("parts"), last(LICENCES[0]).alias("declared"), last(LICENCES[1]).alias("concluded"), F.array_sort(F.collect_list("of.note")).alias("notes"))
    return by.select("doc_id", "declared", "concluded", "notes", F.inline("parts"))


def _package() -> Column:
    purl = F.col("own.purl")
    own = F.when(purl.isNotNull(), F.array(_reference(F.lit("PACKAGE-MANAGER"), F.lit("purl"), purl))).otherwise(F.array().cast(_REF))
    return F.struct(
        F.col("own.id").alias("SPDXID"),
        F.col("own.name").alias("name"),
        F.col("own.version").alias("versionInfo"),
        _first(_role("suppliedBy", _agent)).alias("supplier"),
        F.coalesce(_first(_role("originatedBy", _agent)), _first(_role("builtBy", _agent))).alias("originator"),
        _some(_role("verifiedUsing", _checksum)).alias("checksums"),
        _some(F.concat(own, _role("externalIdentifier", lambda x: _identifier(x, purl)))).alias("externalRefs"),
        F.col("declared").alias("licenseDeclared"),
        F.col("concluded").alias("licenseConcluded"),
        _some(F.transform("notes", _note)).alias("annotations"),
        F.col("own.location").alias("downloadLocation"),
        F.col("own.copyright").alias("copyrightText"),
        F.col("own.comment").alias("comment"),
    )


def _creators() -> Column:
    tool = lambda n: F.when(F.startswith(n, F.lit("Tool: ")), n).otherwise(F.concat(F.lit("Tool: "), n))
    return F.filter(F.concat(_role("createdBy", _agent), F.transform(_role("createdUsing", _agent), tool)), lambda n: n != "")


def _gathered(each: DataFrame) -> DataFrame:
    """One row a document: its parts in order, and the accounting of what was used."""
    kind, own = F.col("kind"), F.col("own")
    is_package, is_relation, is_document = kind.isin(*PACKAGES), kind.isin(*RELATIONS) & ~_is_licence(own), kind.isin(*DOCUMENTS)
    known = (*PACKAGES, *RELATIONS, *AGENTS, *DOCUMENTS, *REACHED, "annotation", "creationinfo")
    listed = lambda when, value, name: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", value.alias("v"))))), lambda x: x["v"]).alias(name)
    text = lambda c: F.coalesce(c, F.lit(""))
    relation = F.struct(text(own["from"]).alias("spdxElementId"), text(own["to"]).alias("relatedSpdxElement"), names.upper_snake(F.coalesce(own["type"], F.lit("OTHER"))).alias("relationshipType"))
    note = F.struct(own["note"].alias("annotationType"), own["statement"].alias("comment"), own["subjects"].alias("subjects"))
    root = F.struct(own["id"].alias("id"), own["name"].alias("name"), _first(_role("namespaceMap", lambda x: x["facts"]["namespace"])).alias("namespace"), _role("import", lambda x: x["facts"]["external"]).alias("imports"))
    info = F.struct(_creators().alias("creators"), own["created"].alias("created"), own["comment"].alias("comment"))
    return each.groupBy("doc_id").agg(
        F.first("about", ignorenulls=True).alias("about"),
        listed(is_package, _package(), "packages"),
        listed(is_relation, relation, "relations"),
        listed(kind == "annotation", note, "notes"),
        F.array_sort(F.collect_list(F.when(is_document, F.struct("at", *[root[c].alias(c) for c in ("id", "name", "namespace", "imports")])))).alias("documents"),
        F.min_by(info, F.when(kind == "creationinfo", F.col("at"))).alias("info"),
        F.count_if(kind.isin(*AGENTS)).alias("agents"),
        F.array_sort(F.collect_set(F.when(~kind.isin(*known), kind))).alias("unmapped_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("own.unread")))).alias("unmapped_package_keys"),
    )


def flat_view(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the flat view, VARIANT; absent facts are absent keys) and accounting of graph documents.

    ``docs``: doc_id, one row each, and doc (VARIANT); its other columns are kept.  A
    document is read once, and one without elements has a view with its version and no
    packages.  accounting: packages, relationships, agents,
    unmapped_types and unmapped_package_keys, which the view leaves out.
    """
    both = _gathered(parts(resolved(elements_and_edges(docs)))).withColumn("__version", F.col("about.version"))
    root = F.get("documents", F.lit(0))
    spaces = F.transform("documents", lambda d: d["namespace"])
    namespace = F.coalesce(root["id"], _first(spaces))
    info = F.col("info")
    creators = F.coalesce(info["creators"], F.array().cast("array<string>"))
    imports = F.flatten(F.transform("documents", lambda d: d["imports"]))
    listed = lambda c: F.coalesce(F.col(c), F.array())
    both = both.withColumn("__namespace", namespace)
    whole = F.filter("notes", lambda n: (F.size(n["subjects"]) == 0) | F.exists(n["subjects"], lambda s: F.coalesce(s == F.col("__namespace"), F.lit(False))))
    view = F.struct(
        F.concat(F.lit("SPDX-"), "__version").alias("spdxVersion"),
        root["name"].alias("name"),
        F.nullif("__namespace", F.lit("")).alias("documentNamespace"),
        F.when((F.size(creators) > 0) | info["created"].isNotNull() | info["comment"].isNotNull(), F.struct(_some(creators).alias("creators"), info["created"].alias("created"), info["comment"].alias("comment"))).alias("creationInfo"),
        listed("packages").alias("packages"),
        _some(F.col("relations")).alias("relationships"),
        _some(F.transform(imports, lambda x: F.struct(x.alias("externalDocumentId"), x.alias("spdxDocument")))).alias("externalDocumentRefs"),
        _some(F.transform(whole, _note)).alias("annotations"),
    )
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    accounting = F.struct(size("packages")("packages"), size("relations")("relationships"), F.coalesce("agents", F.lit(0)).cast("long").alias("agents"), texts("unmapped_types"), texts("unmapped_package_keys"))
    kept = [F.col("about")[c].alias(c) for c in docs.columns if c not in ("doc_id", "doc")]
    return both.select("doc_id", F.parse_json(F.to_json(view)).alias("doc"), accounting.alias("accounting"), *kept)

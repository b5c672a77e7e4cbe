"""Package URLs: parts, advisory keys of five ecosystems, module candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Debian releases by codename.
DEBIAN = {"buster": "10", "bullseye": "11", "bookworm": "12", "trixie": "13", "forky": "14"}


def percent_decode(c: Column) -> Column:
    """Percent decoding that leaves a plus sign alone, and the text where it is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _qualifiers(query: Column) -> Column:
    """The pairs of a query as a map; of equal keys the last."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.lower(percent_decode(F.substring_index(p, "=", 1))).alias("key"), percent_decode(F.substr(p, F.instr(p, "=") + 1)).alias("value")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(entries, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def purl_parts(purl: Column) -> Column:
    """struct(type, segments, version, qualifiers); NULL if it is no package URL."""

    def parts(body: Column) -> Column:
        path = F.regexp_replace(body, r"(?s)\?.*$", "")
        query = F.when(F.instr(body, "?") > 0, F.regexp_replace(body, r"(?s)^[^?]*\?", "")).otherwise("")
        return _let(path, lambda p: _let(F.regexp_extract(p, r"(?s)^.*?@([^@/]*)$", 1), lambda raw: split(p, raw, query)))

    def split(path: Column, raw: Column, query: Column) -> Column:
        versioned = path.rlike(r"(?s)@[^@/]*$")
        base = F.when(versioned, F.substr(path, F.lit(1), F.length(path) - F.length(raw) - 1)).otherwise(path)

        def made(steps: Column) -> Column:
            kind = F.lower(percent_decode(F.get(steps, F.lit(0))))
            return F.struct(kind.alias("type"), F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), percent_decode).alias("segments"), F.when(versioned, F.nullif(percent_decode(raw), F.lit(""))).alias("version"), _qualifiers(query).alias("qualifiers"))

        return _let(F.split(base, "/"), lambda steps: F.when((F.size(steps) > 1) & (F.get(steps, F.lit(0)) != ""), made(steps)))

    return F.when(F.startswith(purl, F.lit("pkg:")), _let(F.regexp_replace(F.substr(purl, F.lit(5)), "(?s)#.*$", ""), parts))


def debian_release(distro: Column) -> Column:
    """Number of a Debian release from a distro qualifier such as debian-11.2 or bookworm."""
    low = F.lower(distro)
    named = F.lit(None).cast("string")
    for code, number in DEBIAN.items():
        named = F.when(F.contains(low, F.lit(code)), number).otherwise(named)
    numbered = F.regexp_extract(low, r"(?:^|[-_])(\d+)(?:\.\d+)*$", 1)
    return F.when(numbered != "", numbered).otherwise(named)


def purl_key(parts: Column) -> Column:
    """struct(ecosystem, name, version, why): the key of advisories, or why there is none."""
    return _let(parts, _key)


def _key(parts: Column) -> Column:
    s, whole = parts["segments"], F.array_join(parts["segments"], "/")
    count = F.size(s)
    release = debian_release(F.try_element_at(parts["qualifiers"], F.lit("distro")))
    answer = lambda eco, name, why=None: F.struct(F.lit(eco).cast("string").alias("ecosystem") if not isinstance(eco, Column) else eco.alias("ecosystem"), (name if isinstance(name, Column) else F.lit(name).cast("string")).alias("name"), parts["version"].alias("version"), F.lit(why).cast("string").alias("why"))
    kind = parts["type"]
    scoped = F.when((count == 1) | F.startswith(whole, F.lit("@")), whole).otherwise(F.concat(F.lit("@"), whole))
    grouped = F.concat(F.array_join(F.slice(s, 1, F.greatest(count - 1, F.lit(0))), "."), F.lit(":"), F.element_at(s, -1))
    return (
        F.when(parts.isNull(), answer(None, None, "not a package URL"))
        .when(kind == "golang", answer("Go", whole))
        .when(kind == "npm", answer("npm", scoped))
        .when((kind == "maven") & (count < 2), answer(None, None, "no group"))
        .when(kind == "maven", answer("Maven", grouped))
        .when(kind == "nuget", answer("NuGet", whole))
        .when((kind == "deb") & F.coalesce(F.try_element_at(parts["qualifiers"], F.lit("distro")), F.lit("")).eqNullSafe(""), answer(None, None, "no distro"))
        .when((kind == "deb") & release.isNull(), answer(None, None, "unknown distro"))
        .when(kind == "deb", answer(F.concat(F.lit("Debian:"), release), F.element_at(s, -1)))
        .otherwise(answer(None, None, "ecosystem not mirrored"))
    )


def key_of(purl: Column) -> Column:
    """:func:`purl_key` of a package URL as it is written; a plain one, the usual case, needs one look and no parsing."""
    plain = purl.rlike(r"^pkg:npm/[A-Za-z0-9._-]+@[A-Za-z0-9._+-]+\z")
    rest = F.substr(purl, F.lit(9))
    answer = F.struct(F.lit("npm").alias("ecosystem"), F.substring_index(rest, "@", 1).alias("name"), F.substring_index(rest, "@", -1).alias("version"), F.lit(None).cast("string").alias("why"))
    return F.when(plain, answer).otherwise(purl_key(purl_parts(purl)))


def module_candidates(path: Column) -> Column:
    """Module paths to try, longest first, down to two segments."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(parts), F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def purl_base(purl: Column) -> Column:
    """What stands before the first at sign."""
    return F.substring_index(purl, "@", 1)

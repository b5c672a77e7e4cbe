"""Small functions of reports: sizes, templates, addresses, crosswalk paths, hash vocabulary, JSON problems."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .versions import trim_all

# Registered names by the formats' own algorithm names; none where none is registered.
REGISTERED = {
    "cyclonedx": {"MD5": "md5", "SHA-1": "sha-1", "SHA-256": "sha-256", "SHA-384": "sha-384", "SHA-512": "sha-512"},
    "spdx": {"MD2": "md2", "MD5": "md5", "SHA1": "sha-1", "SHA224": "sha-224", "SHA256": "sha-256", "SHA384": "sha-384", "SHA512": "sha-512"},
}
UNREGISTERED = {
    "cyclonedx": ("SHA3-256", "SHA3-384", "SHA3-512", "BLAKE2b-256", "BLAKE2b-384", "BLAKE2b-512", "BLAKE3"),
    "spdx": ("SHA3-256", "SHA3-384", "SHA3-512", "BLAKE2b-256", "BLAKE2b-384", "BLAKE2b-512", "BLAKE3", "MD4", "MD6", "ADLER32"),
}


def human_size(size: Column) -> Column:
    """Bytes, KB of 1,024, or decimal MB with one digit."""
    kb = F.round(size / 1024.0, 0).cast("long").cast("string")
    mb = F.round(size / 1e6, 1).cast("decimal(20,1)").cast("string")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" bytes"))).when(size < 1_000_000, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` in a text replaced by its value in one pass; unknown names, and those whose value is NULL, stay.

    What a value holds is never filled again.
    """
    parts = F.regexp_extract_all(template, F.lit(r"(?s)(\{\w+\}|(?:(?!\{\w+\}).)+)"), F.lit(1))
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit(f"{{{name}}}"), value)]) if values else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def attestation(paragraphs: list[str], date: Column, sha256: Column, engine: Column, pack_id: Column, pack_version: Column) -> Column:
    """The attestation of a check: paragraphs with the five stated values filled in, an empty line between them."""
    stated = {"date": date, "sha256": sha256, "engineVersion": engine, "packId": pack_id, "packVersion": pack_version}
    return fill(F.lit("\n\n".join(paragraphs)), stated)


def check_id(*fields: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of fields joined by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 16)


def days_since(when: Column, as_of: str) -> Column:
    """Whole days from a time to a given date."""
    return F.datediff(F.lit(as_of).cast("date"), when.cast("date"))


def stale(when: Column, as_of: str, limit: int = 90) -> Column:
    """Is a time more than ``limit`` days before a given date?"""
    return days_since(when, as_of) > limit


# Media types of pictures that a report may hold.
PICTURES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/svg+xml")


def safe_logo(address: Column) -> Column:
    """A logo's address if it is https without white space, quotes or angle brackets, or a picture in base64; else NULL."""
    v = trim_all(address)
    scheme, rest = F.lower(F.substring_index(v, ":", 1)), F.substr(v, F.instr(v, ":") + 1)
    plain = ~F.exists(F.array(*[F.lit(x) for x in "\"'<>"]), lambda x: F.contains(rest, x)) & ~rest.rlike(r"(?U)\s")
    secure = (scheme == "https") & F.startswith(rest, F.lit("//")) & (F.length(rest) > 2) & plain
    media, body = F.lower(F.substring_index(rest, ";", 1)), F.substr(rest, F.instr(rest, ";") + 1)
    code = F.substr(body, F.lit(8))
    picture = (scheme == "data") & media.isin(*PICTURES) & (F.lower(F.substr(body, F.lit(1), F.lit(7))) == "base64,") & (F.length(code) > 0) & (F.translate(code, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "") == "")
    return F.when(secure | picture, v)


def crosswalk_paths(cell: Column) -> Column:
    """The paths of a crosswalk cell; none for an empty cell or one that says no or none."""
    low = F.lower(trim_all(F.coalesce(cell, F.lit(""))))
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), trim_all), lambda p: p != "")
    return F.when((low == "") | F.startswith(low, F.lit("no ")) | F.startswith(low, F.lit("none")), F.array().cast("array<string>")).otherwise(parts)


# How well a format's field fits an element.
FITS = ("exact", "partial", "none")


def crosswalk(rows: DataFrame) -> DataFrame:
    """(element_id, target, fit, paths): an element's mapping to each format, long.

    ``rows``: cluster, element, and for each of cyclonedx and spdx a cell of paths and a
    fit.  An id is the cluster and the element's name in lower case with hyphens; a
    fit that is none of the known ones is an error, not a silent gap.
    """
    name = F.regexp_replace(F.regexp_replace(F.lower("element"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.lower(trim_all(F.col(f"{t}_fit"))).alias("fit"), crosswalk_paths(F.col(t)).alias("paths")) for t in ("cyclonedx", "spdx")])
    known = F.when(F.col("fit").isin(*FITS), F.col("fit")).otherwise(F.raise_error(F.concat(F.lit("not a fit: "), F.coalesce("fit", F.lit("none given")))))
    return rows.select(F.concat_ws(".", "cluster", name).alias("element_id"), F.inline(each)).withColumn("fit", known)


def crosswalk_tally(mappings: DataFrame) -> DataFrame:
    """(target, a count for each fit, total) of mappings (target, fit); the counts add up to the total."""
    p = mappings.groupBy("target").agg(*[F.count_if(F.col("fit") == f).alias(f) for f in FITS])
    return p.withColumn("total", sum(F.col(f) for f in FITS))


def hash_vocabulary(hashes: DataFrame) -> DataFrame:
    """``hashes`` (format, algorithm) with registered (a name or NULL) and outcome: registered, unregistered or unknown."""
    rows = [(f, a, n) for f, m in REGISTERED.items() for a, n in m.items()] + [(f, a, None) for f, names in UNREGISTERED.items() for a in names]
    known = hashes.sparkSession.createDataFrame(rows, "format string, algorithm string, registered string").withColumn("__known", F.lit(True))
    joined = hashes.join(F.broadcast(known), ["format", "algorithm"], "left")
    said = F.when(F.col("registered").isNotNull(), "registered").when(F.col("__known"), "unregistered").otherwise("unknown")
    return joined.withColumn("outcome", said).drop("__known")


def _problems(raw: pd.Series) -> pd.DataFrame:
    out = []
    for s in raw:
        try:
            json.loads(s or "")
            out.append((None, None))
        except json.JSONDecodeError as e:
            near = " ".join(s[max(0, e.pos - 20) : e.pos + 20].split()) if s else ""
            out.append((e.pos, near or "the end of the file"))
    return pd.DataFrame(out, columns=["offset", "near"])


def json_problem(raw: Column) -> Column:
    """struct(offset, near) of the first place where a text is no JSON; NULLs if it is."""
    return F.pandas_udf(_problems, "offset long, near string")(raw)


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values (the upper of two middles)."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def grouped_upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, upper_median): for each key the value with as many before it as from it on, by counts of equal values.

    Equal values are counted first, so what is ordered for one key is its different values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(key).orderBy(value))
    whole = F.sum("__n").over(Window.partitionBy(key))
    placed = counted.select(key, F.col(value).alias("upper_median"), upto.alias("__upto"), F.floor(whole / 2).alias("__at"))
    return placed.where(F.col("__upto") > F.col("__at")).groupBy(key).agg(F.min("upper_median").alias("upper_median"))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent to one decimal; NULL of nothing."""
    return F.round(F.try_divide(part * 100.0, whole), 1)

"""Supplier tables to draft documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings, as letters and digits only, by the field they fill.
HEADINGS = {
    "name": ("name", "component", "componentname", "product", "productname", "library", "package"),
    "version": ("version", "ver", "componentversion", "productversion", "release"),
    "supplier": ("supplier", "vendor", "manufacturer", "author", "publisher", "producer", "componentproducer"),
    "purl": ("purl", "packageurl"),
    "cpe": ("cpe", "cpe23"),
    "license": ("license", "licence", "licenseid", "licenceid", "spdx", "spdxid"),
    "support": ("supportlevel", "support", "levelofsupport"),
    "end_of_support": ("endofsupport", "endofsupportdate", "eos", "eol", "endoflife"),
}


def _heading(cell: Column) -> Column:
    return F.regexp_replace(F.lower(cell), "[^a-z0-9]", "")


def mapped_rows(rows: DataFrame) -> DataFrame:
    """One row per table row with the fields that its file's heading names; the first column of a field wins.

    ``rows`` as the table readers give them: path, row_number (0: heading), cells, ragged, problem.
    """
    heads = rows.where("row_number = 0 AND problem IS NULL").select("path", F.transform("cells", _heading).alias("heads"))
    body = rows.where("row_number > 0").join(heads, "path")

    def cell(field: str) -> Column:
        places = F.filter(F.transform("heads", lambda h, i: F.when(h.isin(*HEADINGS[field]), i)), lambda i: i.isNotNull())
        return F.nullif(F.trim(F.get("cells", F.get(places, F.lit(0)))), F.lit(""))

    return body.select("path", "row_number", "ragged", *[cell(f).alias(f) for f in HEADINGS])


def unmapped(rows: DataFrame) -> DataFrame:
    """(path, columns, n_rows, n_problems): headings of a file that no field takes, as written, and what was read of it."""
    known = [h for hs in HEADINGS.values() for h in hs]
    other = F.filter("cells", lambda c: (F.trim(c) != "") & ~_heading(c).isin(*known))
    return rows.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("row_number") == 0, other)), F.array().cast("array<string>")).alias("columns"),
        F.count_if(F.col("row_number") > 0).alias("n_rows"),
        F.count_if(F.col("problem").isNotNull()).alias("n_problems"),
    )


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, doc VARIANT, n_components, n_ragged, n_unnamed): a draft document for each file.

    A draft is marked as one in its metadata.  Rows without a name are counted, not kept
    as components; a file without a name column gives a document without components.
    """
    fields = mapped_rows(rows)
    prop = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(c).alias("value")))
    properties = F.filter(F.array(prop("draft:support-level", "support"), prop("draft:end-of-support", "end_of_support")), lambda x: x.isNotNull())
    licence = F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("name")).alias("license"))))
    component = F.struct(F.lit("library").alias("type"), "name", "version", F.col("supplier").alias("publisher"), "purl", "cpe", licence.alias("licenses"), F.when(F.size(properties) > 0, properties).alias("properties"))
    per = fields.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("row_number", component.alias("c"))))).alias("cs"), F.count_if("ragged").alias("n_ragged"), F.count_if(F.col("name").isNull()).alias("n_unnamed"))
    mark = F.struct(F.array(F.struct(F.lit("tessera:draft").alias("name"), F.lit("true").alias("value"))).alias("properties"))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), mark.alias("metadata"), F.transform("cs", lambda x: x["c"]).alias("components"))
    return per.select(F.col("path").alias("doc_id"), F.parse_json(F.to_json(doc)).alias("doc"), F.size("cs").alias("n_components"), "n_ragged", "n_unnamed")

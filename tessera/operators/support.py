"""End of support: the release line of a version, and whether it has ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions


def support_state(components: DataFrame, products: DataFrame, cycles: DataFrame, as_of: str) -> DataFrame:
    """``components`` (component_id unique, name, version) with cycle, end_of_support, past_end, why.

    ``products``: name, product.  ``cycles``: product, cycle, eol_date, eol_flag: a date,
    or a flag where the source gives none (false: ended).  The longest line that a
    version falls into is its line.  ``as_of`` is given, so that a report can be made again.
    """
    v = F.regexp_replace(versions.trim_all(F.col("version")), "(?i)^v", "")
    known = components.join(products, "name", "left").withColumn("__v", v)
    asked = known.select("product", "__v").where(F.col("product").isNotNull() & F.col("__v").rlike(r"^\d")).distinct()
    out = known.join(release_lines(asked, cycles), ["product", "__v"], "left")
    past = F.when(F.col("__c.eol_date").isNotNull(), F.col("__c.eol_date") < F.lit(as_of).cast("date")).otherwise(~F.coalesce("__c.eol_flag", F.lit(True)))
    why = F.when(F.col("product").isNull(), "no data for this component").when(~F.coalesce(F.col("__v").rlike(r"^\d"), F.lit(False)), "not a version").when(F.col("__c").isNull(), "in no release line")
    return out.select(*components.columns, F.col("__c.cycle").alias("cycle"), F.col("__c.eol_date").alias("end_of_support"), F.when(F.col("__c").isNotNull(), past).alias("past_end"), why.alias("why"))


def release_lines(asked: DataFrame, cycles: DataFrame) -> DataFrame:
    """(product, __v, __c): the longest line (cycle, eol_date, eol_flag) that each distinct version of a product falls into.

    A version is cut where no digit is split, at the lengths that lines of its product
    have, and each piece is looked up: rows grow with those lengths, not with the lines.
    """
    lengths = cycles.where("cycle IS NOT NULL").groupBy("product").agg(F.collect_set(F.length("cycle")).alias("__lengths"))
    whole = lambda n: (n <= F.length("__v")) & versions.in_cycle(F.col("__v"), F.substr("__v", F.lit(1), n))
    tried = asked.join(lengths, "product").select("product", "__v", F.explode(F.filter("__lengths", whole)).alias("__n"))
    tried = tried.select("product", "__v", F.substr("__v", F.lit(1), "__n").alias("cycle"))
    met = tried.join(cycles.select("product", "cycle", "eol_date", "eol_flag"), ["product", "cycle"])
    return met.groupBy("product", "__v").agg(F.max_by(F.struct("cycle", "eol_date", "eol_flag"), F.length("cycle")).alias("__c"))


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Vendor prefixes, and endings of parts of a product.
_PREFIX = "^(lib|python3?-|golang-|node-|ruby-|perl-)"
_ENDING = r"(-js|-core|-client|-server|-common|-dev|\d+)$"


def slug_candidates(name: Column) -> Column:
    """Product slugs to try for a component name, nearest first: whole, last word, without prefix, without ending, last part of a path."""
    whole = slug(name)
    last = F.element_at(F.split(whole, "-"), -1)
    part = F.when(F.contains(name, F.lit("/")), slug(F.element_at(F.split(name, "/"), -1)))
    tried = F.array(whole, last, F.regexp_replace(whole, _PREFIX, ""), F.regexp_replace(whole, _ENDING, ""), part)
    return F.array_distinct(F.filter(tried, lambda s: s.isNotNull() & (s != "")))


def match_products(names: DataFrame, products: DataFrame) -> DataFrame:
    """(name, product): the product of the nearest slug of each distinct name that has one.

    ``products``: product, and slug or none (then the product's own).  Of products with
    one slug the greatest counts.
    """
    own = products if "slug" in products.columns else products.withColumn("slug", slug(F.col("product")))
    one = own.groupBy("slug").agg(F.max("product").alias("product"))
    tried = names.select("name").distinct().select("name", F.posexplode(slug_candidates(F.col("name"))).alias("at", "slug"))
    return tried.join(one, "slug").groupBy("name").agg(F.min_by("product", "at").alias("product"))


def product_coverage(names: DataFrame, products: DataFrame) -> DataFrame:
    """One row: distinct names and instances in all, and those with a product, with shares in percent."""
    counted = names.where(F.col("name") != "").groupBy("name").agg(F.count("*").alias("__n")).join(match_products(names, products), "name", "left")
    has = F.col("product").isNotNull()
    sums = counted.agg(F.count("*").alias("names"), F.coalesce(F.sum("__n"), F.lit(0)).alias("instances"), F.count_if(has).alias("names_matched"), F.coalesce(F.sum(F.when(has, F.col("__n"))), F.lit(0)).alias("instances_matched"))
    share = lambda a, b: F.round(F.try_divide(F.col(a) * 100.0, b), 1)
    return sums.select("*", share("names_matched", "names").alias("names_percent"), share("instances_matched", "instances").alias("instances_percent"))


def product_data(names: DataFrame, products: DataFrame, cycles: DataFrame, source: str, captured_at: str) -> DataFrame:
    """(product, cycles, source, captured_at): the release lines of every product that the names reach, newest first as given.

    ``cycles``: product, position, cycle, eol (a date as text, or true or false), lts, latest.
    """
    reached = match_products(names, products).select("product").distinct()
    line = F.struct("position", "cycle", "eol", F.coalesce("lts", F.lit(False)).alias("lts"), "latest")
    per = cycles.join(reached, "product", "left_semi").groupBy("product").agg(F.sort_array(F.collect_list(line)).alias("cycles"))
    return per.select("product", "cycles", F.lit(source).alias("source"), F.lit(captured_at).alias("captured_at"))


def freshness(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(product, cycle, state): same, drifted, gone or absent, by a full outer join."""
    s = stored.select("product", "cycle", F.col("eol").alias("__s"), F.lit(1).alias("__hs"))
    both = s.join(live.select("product", "cycle", F.col("eol").alias("__l"), F.lit(1).alias("__hl")), ["product", "cycle"], "full_outer")
    state = F.when(F.col("__hs").isNull(), "absent").when(F.col("__hl").isNull(), "gone").when(F.col("__s").eqNullSafe(F.col("__l")), "same").otherwise("drifted")
    return both.select("product", "cycle", state.alias("state"))

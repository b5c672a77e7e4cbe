"""Resolving component names to package identifiers, or abstaining; and scoring that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, purl
from ..functions.versions import trim_all
from ..shipping import ship

PURL = r"^pkg:[A-Za-z][A-Za-z0-9.+-]*/.+"


def resolve(inputs: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """``inputs`` (input unique) with purl_base, method, matched_on, observations; all NULL is abstention.

    ``aliases``: alias, purl_base, observations.  Tiers: an identifier as it is; the
    alias as written; its normal form; then reversible forms, nearest first, where two
    forms that disagree mean abstention.  Only what the first tiers leave goes further.
    """
    ship(inputs.sparkSession)
    known = aliases.where(F.col("observations") >= least).select("alias", "purl_base", "observations")
    raw = inputs.withColumn("__raw", trim_all(F.coalesce("input", F.lit("")))).withColumn("__norm", names.norm(F.coalesce("input", F.lit(""))))
    given = F.col("__raw").rlike(PURL)
    long = F.length("__raw") >= 2
    one = known.select(F.col("alias").alias("__raw"), F.struct("purl_base", "observations").alias("__exact"))
    two = known.select(F.col("alias").alias("__norm"), F.struct("purl_base", "observations").alias("__viaNorm"))
    tiers = raw.join(one, "__raw", "left").join(two, "__norm", "left")
    open_ = long & ~given & F.col("__exact").isNull() & F.col("__viaNorm").isNull()
    forms = tiers.where(open_).select("input", "__raw").distinct().select("input", F.posexplode(names.candidates("__raw")).alias("at", "alias"))
    met = forms.join(known, "alias").groupBy("input").agg(F.count_distinct("purl_base").alias("n"), F.min_by(F.struct("purl_base", "observations", "alias"), "at").alias("__near"))
    both = tiers.join(met.where("n = 1").select("input", "__near"), "input", "left")
    first = lambda a, b, c, d: F.when(~long, None).when(given, a).when(F.col("__exact").isNotNull(), b).when(F.col("__viaNorm").isNotNull(), c).otherwise(d)
    no = F.lit(None).cast("string")
    return both.select(
        *inputs.columns,
        first(purl.purl_base(F.col("__raw")), F.col("__exact.purl_base"), F.col("__viaNorm.purl_base"), F.col("__near.purl_base")).alias("purl_base"),
        first(F.lit("exact"), F.lit("exact"), F.lit("dictionary"), F.when(F.col("__near").isNotNull(), "heuristic").otherwise(no)).alias("method"),
        first(F.col("__raw"), F.col("__raw"), F.col("__norm"), F.col("__near.alias")).alias("matched_on"),
        first(F.lit(0).cast("long"), F.col("__exact.observations").cast("long"), F.col("__viaNorm.observations").cast("long"), F.col("__near.observations").cast("long")).alias("observations"),
    )


def score(rows: DataFrame) -> DataFrame:
    """Per resolver and subset: precision, recall, F1, abstention, and the rows without an answer.

    ``rows``: resolver, input, purl (NULL where there is no right answer), perturbation
    (NULL for rows as observed), got (NULL for abstention).  Subsets overlap: all, clean
    and perturbed.
    """
    subset = F.array(F.lit("all"), F.when(F.col("perturbation").isNull(), "clean").otherwise("perturbed"))
    right = F.col("got").isNotNull() & F.col("purl").isNotNull() & (F.col("got") == F.col("purl"))
    n = rows.withColumn("subset", F.explode(subset)).groupBy("resolver", "subset").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("purl").isNotNull()).alias("answerable"),
        F.count_if(right).alias("tp"),
        F.count_if(F.col("got").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("fp"),
        F.count_if(F.col("got").isNull()).alias("abstained"),
        F.count_if(F.col("purl").isNull()).alias("unknown_class"),
        F.count_if(F.col("purl").isNull() & F.col("got").isNotNull()).alias("unknown_fp"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("answerable"))
    return n.select("resolver", "subset", "rows", (F.col("tp") + F.col("fp")).alias("answered"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.round(ratio(F.col("abstained"), F.col("rows")), 4).alias("abstention"), "unknown_class", "unknown_fp")


def best(scores: DataFrame, measure: str = "f1", within: float = 1e-9) -> DataFrame:
    """The resolvers that reach the highest ``measure`` of their subset, ties kept."""
    top = scores.groupBy("subset").agg(F.max(measure).alias("__top"))
    return scores.join(top, "subset").where(F.abs(F.col(measure) - F.col("__top")) <= within).drop("__top")

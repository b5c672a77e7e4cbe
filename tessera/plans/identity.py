"""The resolver benchmark: rows built from components, baselines, and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, purl
from ..operators import resolve

# The shapes that documents give names, each a row family of the benchmark.
SHAPES = ("archive", "prefix", "parenthesis", "version", "spaces", "upper")


def perturbed(rows: DataFrame, seed: int = 20260913) -> DataFrame:
    """One perturbed row for each row with a right answer: its shape is chosen by a hash, so it can be made again."""
    at = F.pmod(F.xxhash64("input", F.lit(seed)), F.lit(len(SHAPES)))
    n = F.col("input")
    shaped = F.when(at == 0, F.concat(n, F.lit(".tar.gz"))).when(at == 1, F.concat(F.lit("lib"), n)).when(at == 2, F.concat(n, F.lit(" (bundled)"))).when(at == 3, F.concat(n, F.lit("-1.2.3"))).when(at == 4, F.replace(n, F.lit("-"), F.lit(" "))).otherwise(F.upper(n))
    return rows.where("purl IS NOT NULL").select(shaped.alias("input"), "purl", F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (at + 1).cast("int")).alias("perturbation"))


def dataset(components: DataFrame) -> DataFrame:
    """(input, purl, perturbation): names as observed, perturbed names, names without a path, names without an answer.

    ``components``: name, purl.  Of rows with the same input the first wins, in the
    order of the families and then of the answer.
    """
    seen = components.where(F.length("name") >= 2).select(F.col("name").alias("input"), purl.purl_base(F.col("purl")).alias("purl")).distinct().withColumn("perturbation", F.lit(None).cast("string"))
    last = seen.where(F.contains("input", F.lit("/"))).select(F.element_at(F.split("input", "/"), -1).alias("input"), F.lit(None).cast("string").alias("purl"), F.lit("path").alias("perturbation"))
    families = [seen.where("purl IS NOT NULL"), perturbed(seen), last, seen.where("purl IS NULL")]
    rows = None
    for k, f in enumerate(families):
        f = f.select("input", "purl", "perturbation", F.lit(k).alias("family"))
        rows = f if rows is None else rows.unionByName(f)
    first = rows.groupBy("input").agg(F.min(F.struct("family", "purl", "perturbation")).alias("r"))
    return first.select("input", "r.purl", "r.perturbation")


# The prefixes that the prefix-strip baseline takes away, in order.
STRIPPED = ("lib", "python-", "node-", "golang-", "perl-", "ruby-")


def prefix_strip(data: DataFrame, known: DataFrame) -> DataFrame:
    """The normal form without its first prefix that leaves a known alias (``__k``, got), else as it is."""
    n = names.norm(F.col("input"))
    forms = [*(F.when(F.startswith(n, F.lit(p)), names.norm(F.substr(n, F.lit(len(p) + 1)))) for p in STRIPPED), n]
    tried = data.select("input", F.posexplode(F.array(*forms)).alias("at", "__k")).where("__k IS NOT NULL")
    met = tried.join(known, "__k").groupBy("input").agg(F.min_by("got", "at").alias("got"))
    return data.join(met, "input", "left").select(F.lit("prefix-strip").alias("resolver"), "input", "purl", "perturbation", "got")


def baselines(data: DataFrame, aliases: DataFrame) -> DataFrame:
    """Predictions (resolver, input, purl, perturbation, got) of the baselines and of the resolver."""
    known = aliases.select(F.col("alias").alias("__k"), F.col("purl_base").alias("got"))
    key = lambda name, c: data.withColumn("__k", c).join(known, "__k", "left").select(F.lit(name).alias("resolver"), "input", "purl", "perturbation", "got")
    none = data.select(F.lit("always-abstain").alias("resolver"), "input", "purl", "perturbation", F.lit(None).cast("string").alias("got"))
    own = resolve.resolve(data, aliases).select(F.lit("tiers").alias("resolver"), "input", "purl", "perturbation", F.col("purl_base").alias("got"))
    return none.unionByName(key("exact-match", F.col("input"))).unionByName(key("normalised-match", names.norm(F.col("input")))).unionByName(prefix_strip(data, known)).unionByName(own)


def ordered(data: DataFrame) -> DataFrame:
    """The rows of a dataset by class (those as observed first), then by input."""
    return data.orderBy(F.col("perturbation").isNotNull(), "perturbation", "input")


def write_predictions(resolved: DataFrame, folder: str) -> None:
    """One JSON object a line: input, purl (null for abstention) and method (``abstain`` for none)."""
    rows = resolved.select("input", F.col("purl_base").alias("purl"), F.coalesce("method", F.lit("abstain")).alias("method"))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def benchmark(components: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scores of every resolver on every subset."""
    return resolve.score(baselines(dataset(components), aliases))


def split_problems(train: DataFrame, held: DataFrame, everything: DataFrame) -> DataFrame:
    """(input, problem): rows in both parts, or in neither."""
    both = train.select("input").intersect(held.select("input")).withColumn("problem", F.lit("in both"))
    neither = everything.select("input").distinct().join(train.select("input").union(held.select("input")), "input", "left_anti").withColumn("problem", F.lit("in neither"))
    return both.unionByName(neither)

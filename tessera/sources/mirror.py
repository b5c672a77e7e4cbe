"""The advisory mirror: building it from exports, writing, opening, and its status."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.advisories import AFFECTED
from ..storage import written
from . import shards as shard_files
from .documents import read_archives

VERSION = 1
ADVISORY = f"id string, aliases array<string>, summary string, modified string, affected {AFFECTED.replace('name:string,ecosystem:string', 'package:struct<name:string,ecosystem:string>')}"


def compact(entries: DataFrame) -> DataFrame:
    """(source, kind, ecosystem, name, id, aliases, summary, affected): advisories by the packages they name.

    ``entries``: source and raw JSON.  Prose is left out at once, entries that name no
    package are none, an id under ``MAL-`` is a malicious-package report, and a key
    holds an id once however many exports carry it: that of the first source by name,
    and there the first by its text.
    """
    read = entries.select("source", F.from_json("raw", ADVISORY).alias("a")).where("a.id IS NOT NULL")
    flat = F.transform("a.affected", lambda x: F.struct(x["package"]["name"].alias("name"), x["package"]["ecosystem"].alias("ecosystem"), x["versions"].alias("versions"), x["ranges"].alias("ranges")))
    named = F.filter(flat, lambda x: F.coalesce(x["name"], F.lit("")) != "")
    kind = F.when(F.startswith("a.id", F.lit("MAL-")), "malicious").otherwise("vulnerability")
    rows = read.select("source", kind.alias("kind"), F.col("a.id").alias("id"), F.col("a.aliases").alias("aliases"), F.col("a.summary").alias("summary"), named.alias("affected"))
    each = rows.withColumn("p", F.explode(F.array_distinct(F.transform("affected", lambda x: F.struct(x["ecosystem"].alias("ecosystem"), x["name"].alias("name"))))))
    rest = F.struct("source", "aliases", "summary", "affected")
    keyed = each.select("kind", F.col("p.ecosystem").alias("ecosystem"), F.col("p.name").alias("name"), "id", rest.alias("r"))
    once = keyed.groupBy("kind", "ecosystem", "name", "id").agg(F.min_by("r", F.struct("r.source", F.to_json("r"))).alias("r"))
    return once.select("r.source", "kind", "ecosystem", "name", "id", "r.aliases", "r.summary", "r.affected")


def counts(rows: DataFrame) -> DataFrame:
    """(kind, ecosystem, names, advisories) of compacted rows."""
    return rows.groupBy("kind", "ecosystem").agg(F.count_distinct("name").alias("names"), F.count_distinct("id").alias("advisories"))


def build(exports: DataFrame, kev: DataFrame, folder: str, fetched_at: str) -> None:
    """Write a mirror from zip exports (path, content, and ecosystem where it is known) and the catalogue of exploited ids.

    Shards are files by kind and ecosystem, and with the other tables a generation; the
    manifest that puts it in force comes last, so a run that fails at any point leaves
    the mirror before it whole.  ``sources`` has a row for each export
    with its counts and its problem, NULL for none.  An export mirrors its ``ecosystem``
    as given, or else its file's name without the ending, and those that its entries
    name; so an empty or a broken export is still known as mirrored, and a broken one
    as not loaded.
    """
    spark = exports.sparkSession
    name = F.element_at(F.split("path", "/"), -1)
    stated = F.col("ecosystem") if "ecosystem" in exports.columns else F.regexp_replace(name, r"\.zip$", "")
    files = exports.select("path", name.alias("source"), stated.alias("stated"), F.sha2("content", 256).alias("sha256"))
    # Archives are opened once; their entries are dealt out anew when they are read.
    read = written(read_archives(exports).withColumn("source", name), "entries")
    problems = read.where("problem IS NOT NULL").groupBy("source").agg(F.min(F.concat_ws(": ", "entry", "problem")).alias("problem"))
    entries = read.where("problem IS NULL").where(F.endswith("entry", F.lit(".json")))
    rows = compact(entries.select("source", F.decode("content", "UTF-8").alias("raw")))
    generation = uuid.uuid4().hex
    spread = rows.withColumn("__part", F.pmod(F.xxhash64("name"), F.lit(16))).repartition("kind", "ecosystem", "__part").sortWithinPartitions("kind", "ecosystem", "name", "id")
    shard_files.register(spark)
    shape = spark.createDataFrame([], shard_files.SCHEMA).schema
    target = {"path": folder, "generation": generation}
    spread.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape]).write.format(shard_files.FORMAT).options(publish="false", **target).mode("overwrite").save()
    held_rows = spark.read.format(shard_files.FORMAT).options(**target).load()
    seen = held_rows.groupBy("source").agg(F.count_distinct(F.when(F.col("kind") == "vulnerability", F.col("id"))).alias("vulnerabilities"), F.count_distinct(F.when(F.col("kind") == "malicious", F.col("id"))).alias("malicious"), F.collect_set("ecosystem").alias("__seen"))
    out = files.join(seen, "source", "left").join(problems, "source", "left").fillna(0, ["vulnerabilities", "malicious"])
    held = F.array_sort(F.array_distinct(F.concat(F.coalesce("__seen", F.array().cast("array<string>")), F.array("stated"))))
    out = out.select("source", "sha256", "vulnerabilities", "malicious", held.alias("ecosystems"), F.col("stated").alias("ecosystem"), "problem", F.lit(fetched_at).alias("fetched_at"), F.lit(VERSION).alias("schema_version"))
    out.write.parquet(f"{folder}/data/{generation}/sources")
    kev.select("id").distinct().write.parquet(f"{folder}/data/{generation}/kev")
    shard_files.publish(folder, generation, {"fetched_at": fetched_at, "schema_version": VERSION})


def read_kev(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """((id) of every advisory in an exploited-vulnerabilities catalogue file, problem): an absent or unreadable file is a problem, not an error."""
    none = spark.createDataFrame([], "id string")
    try:
        raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("raw"))
    except AnalysisException:
        return none, "the catalogue is absent"
    if raw.where(F.try_parse_json("raw").isNull()).limit(1).count() or raw.isEmpty():
        return none, "the catalogue is not JSON"
    ids = raw.select(F.explode(F.from_json("raw", "vulnerabilities array<struct<cveID:string>>")["vulnerabilities"]).alias("v"))
    return ids.select(F.col("v.cveID").alias("id")).where("id IS NOT NULL").distinct(), None


def open_mirror(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(advisories, kev, sources) of the mirror in force; refuses one of another schema version.

    ``advisories`` has a row with a ``problem`` for each file that cannot be read, and
    filters on kind and ecosystem read the shards asked for alone.
    """
    held = shard_files.newest(folder)
    if held is None:
        raise FileNotFoundError(f"{folder} holds no mirror")
    if held.get("schema_version") != VERSION:
        raise ValueError(f"the mirror has another schema version than {VERSION}")
    shard_files.register(spark)
    at = f"{folder}/data/{held['generation']}"
    rows = spark.read.format(shard_files.FORMAT).options(path=folder, generation=held["generation"]).load()
    return rows, spark.read.schema("id string").parquet(f"{at}/kev"), spark.read.parquet(f"{at}/sources")


def shard_problems(rows: DataFrame) -> DataFrame:
    """(ecosystem, problem) of shards that could not be read, for :func:`shards` and :func:`status`."""
    return rows.where("problem IS NOT NULL").select("ecosystem", "problem").distinct()


def shards(sources: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(ecosystem, loaded): what is mirrored, and whether it could be read.

    An export's own problem counts for the ecosystem it states; ``problems`` (ecosystem,
    problem) adds shards that were found to be broken later.
    """
    held = sources.select(F.explode("ecosystems").alias("ecosystem")).distinct()
    bad = sources.where("problem IS NOT NULL").select("ecosystem")
    if problems is not None:
        bad = bad.unionByName(problems.where("problem IS NOT NULL").select("ecosystem"))
    return held.join(bad.distinct().withColumn("__ok", F.lit(False)), "ecosystem", "left").select("ecosystem", F.coalesce("__ok", F.lit(True)).alias("loaded"))


def status(sources: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(ecosystem, loaded, exports, vulnerabilities, malicious, problem): what the mirror holds, by ecosystem."""
    each = sources.select(F.explode("ecosystems").alias("__e"), "ecosystem", "source", "vulnerabilities", "malicious", "problem")
    each = each.select(F.col("__e").alias("ecosystem"), "source", "vulnerabilities", "malicious", F.when(F.col("__e") == F.col("ecosystem"), F.col("problem")).alias("problem"))
    by = each.groupBy("ecosystem").agg(F.count_distinct("source").alias("exports"), F.sum("vulnerabilities").alias("vulnerabilities"), F.sum("malicious").alias("malicious"), F.min("problem").alias("problem"))
    return shards(sources, problems).join(by, "ecosystem", "left")


def read_shard_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advisories, problems) of JSON shard files (ecosystem, kind, content): name to advisories.

    A corrupt shard is a problem with its reason, never an empty shard.
    """
    read = files.select("ecosystem", "kind", F.decode("content", "UTF-8").alias("raw"))
    shape = f"map<string,array<struct<id:string,aliases:array<string>,summary:string,affected:{AFFECTED}>>>"
    parsed = read.withColumn("valid", F.try_parse_json("raw").isNotNull()).withColumn("m", F.from_json("raw", shape))
    problems = parsed.select("ecosystem", F.when(~F.col("valid"), "not JSON").alias("problem")).where("problem IS NOT NULL")
    rows = parsed.where("valid").select("kind", "ecosystem", F.explode("m").alias("name", "list")).select("kind", "ecosystem", "name", F.inline("list"))
    return rows, problems


def manifest(sources: DataFrame) -> str:
    """The sources as stable JSON."""
    return json.dumps([r.asDict(True) for r in sources.orderBy("source").collect()], sort_keys=True, indent=2, default=str) + "\n"

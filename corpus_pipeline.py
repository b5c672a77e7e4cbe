"""A corpus pipeline: toxicity, quality, near-duplicates, decontamination, mixing.

Every stage works on all rows that the one before it kept and returns the columns of
``documents``; other columns of its input are left out, whatever their names.  In all
stages a null text counts as an empty one, very long texts are read whole, repeated rows
are judged alike (they stay or go together), rows without a doc_id are judged by their
text alone, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, toxicity
from tessera.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity.  Null and empty texts score by the model's bias; without labels all stay."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality.  Null and empty texts have all features 0; without labels all stay."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id.  All null and empty texts are one group; rows without an id stay."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.  Null texts and rows without an id hold none; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per taken copy of a document, with pass, block and place.  A null source is a source of its own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: Trained scores, fingerprints and components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

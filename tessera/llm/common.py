"""Shared plumbing of the training-data operators: tables, shared storage, shipping."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import shared_dir

__all__ = ["crc_mod", "materialise", "pieces", "sampled_ids", "shared_dir", "ship", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in slices of at most ``rows`` rows, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_or_empty(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def sampled_ids(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """``rows`` (distinct in ``key``) with the ``size`` smallest hashes of it, ties by the key.

    Only rows under a limit that about twice ``size`` rows pass are sorted, so neither
    the driver nor a task gets more than that, however many rows there are.
    """
    n = rows.count()
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    if n > 2 * size:
        rows = rows.where(h < F.lit(int(2**63 * min(1.0, 2 * size / n))).cast("long"))
    return rows.orderBy(h, key).limit(size)

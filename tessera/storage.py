"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and all run in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = Path(tempfile.gettempdir(), "checkpoints", f"tessera-{uuid.uuid4().hex}")
    made.mkdir(parents=True)
    spark.sparkContext.setCheckpointDir(made.as_uri())
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: worked out once, whoever reads it, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(folder: str) -> tuple:
    """(file system, path) of a folder in any store that pyarrow knows; a path without a scheme is local."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)

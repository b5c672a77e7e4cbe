"""Reading documents, packs, overrides and archives."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_object
from ..operators.rules import Pack, check_overrides, load_pack
from ..shipping import ship


def _repair(raw: pd.Series) -> pd.Series:
    """What the strict parser refuses but a lenient one reads (duplicate keys: the last wins), written again."""

    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s), ensure_ascii=False)
        except ValueError:
            return None

    return raw.map(one)


def parse_documents(files: DataFrame) -> DataFrame:
    """(doc_id, sha256, raw, doc VARIANT) of binary files (path, content); ``doc`` is NULL for what is not JSON.

    A leading byte order mark is skipped.  Only texts that the engine's parser refuses
    go through Python.
    """
    ship(files.sparkSession)
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    read = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.sha2("content", 256).alias("sha256"), raw.alias("raw"))
    read = read.withColumn("doc", F.try_parse_json("raw"))
    lenient = F.pandas_udf(_repair, "string")(F.when(F.col("doc").isNull(), F.col("raw")))
    return read.withColumn("__again", lenient).select("doc_id", "sha256", "raw", F.coalesce("doc", F.try_parse_json("__again")).alias("doc"))


def read_documents(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("provenance.json",)) -> DataFrame:
    """All .json files of a folder (any store), but for ``exclude``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return parse_documents(files.where(~F.element_at(F.split("path", "/"), -1).isin(*exclude)).select("path", "content"))


def read_pack(spark: SparkSession, path: str) -> Pack:
    """A rule pack from a JSON file, validated."""
    return load_pack(json.loads(_whole(spark, path)))


def read_overrides(spark: SparkSession, path: str, pack: Pack) -> tuple[dict, str, int]:
    """(overrides by rule, sha256 of the file, how many were asked for); refuses a file that cannot be used."""
    text = _whole(spark, path)
    data = json.loads(text)
    asked = data["overrides"] if isinstance(data, dict) and isinstance(data.get("overrides"), list) else data
    if not isinstance(asked, list):
        raise ValueError("an overrides file holds a list")
    return check_overrides(asked, pack), hashlib.sha256(text.encode()).hexdigest(), len(asked)


def _whole(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode("utf-8-sig")


def sniff(content) -> object:
    """xlsx, pdf or text, by the first bytes."""
    head = F.substring(content, 1, 1024)
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "xlsx").when(F.instr(F.decode(head, "ISO-8859-1"), "%PDF-") > 0, "pdf").otherwise("text")


ENTRY = "path string, entry string, size long, content binary, problem string"


#: What a damaged or foreign archive raises.
BROKEN = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, ValueError)


#: Entries leave a task in frames of about this many rows or bytes of content, since a frame of its own costs far more than an entry.
FRAME = (4096, 16 << 20)


def _entries(path: str, content: bytes | None) -> Iterator[tuple]:
    """(path, entry, size, content, problem) of every entry of an archive."""
    if content is None:
        yield path, None, 0, None, "no content"
        return
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except BROKEN as e:
        yield path, None, 0, None, str(e) or "unreadable"
        return
    with z:
        for info in z.infolist():
            try:
                yield path, info.filename, info.file_size, z.read(info), None
            except BROKEN as e:
                yield path, info.filename, info.file_size, None, str(e) or "unreadable"


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    frame = lambda: pd.DataFrame(rows, columns=["path", "entry", "size", "content", "problem"])
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            for row in _entries(path, content):
                rows.append(row)
                held += len(row[3] or b"")
                if len(rows) >= FRAME[0] or held >= FRAME[1]:
                    yield frame()
                    rows, held = [], 0
    if rows:
        yield frame()


def read_archives(files: DataFrame) -> DataFrame:
    """One row per entry of zip archives (path, content).

    A broken archive, or one without content, is a row with its problem and no entry;
    a broken entry is a row with its problem beside the entries that can be read.
    """
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_unzip, ENTRY)


def outcome(docs: DataFrame, most_bytes: int = 25_000_000) -> DataFrame:
    """(doc_id, outcome): what a reader would be told about each document before any rule runs."""
    from ..functions.values import child, items
    from ..operators.detect import detect

    doc = F.col("doc")
    seen = docs.withColumn("__d", detect(doc))
    parts = F.size(items(child(doc, "components"))) + F.size(items(child(doc, "packages")))
    said = (
        F.when(F.octet_length("raw") > most_bytes, "too-large")
        .when(F.trim("raw") == "", "empty")
        .when(doc.isNull(), "not-json")
        .when(~is_object(doc), "not-an-object")
        .when(F.col("__d.format").isNull(), "unknown-format")
        .when(~F.col("__d.supported"), "unsupported-version")
        .when(parts == 0, "no-components")
        .otherwise("checked")
    )
    return seen.select("doc_id", said.alias("outcome"))

"""A folder of documents, checked as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..operators.rules import Pack
from ..sources.documents import parse_documents


def stream_documents(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Documents of ``folder`` as a stream: doc_id, sha256, raw, doc."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", per_trigger).load(folder)
    return parse_documents(files.select("path", "content"))


def check_stream(spark: SparkSession, folder: str, pack: Pack, out: str, checkpoint: str) -> StreamingQuery:
    """Check every new document once; its findings are written to ``out``, a folder a batch.

    Restarts from ``checkpoint``; a batch that is tried again overwrites what it wrote.
    """
    table = rules.rule_table(spark, pack)

    def check(batch: DataFrame, number: int) -> None:
        found = rules.findings(rules.gated(rules.evaluate(batch, pack)), table)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_documents(spark, folder).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_only(requests: DataFrame) -> DataFrame:
    """Of the answers to each asker only the newest request's: (asker, request, answer) by highest request."""
    return requests.groupBy("asker").agg(F.max_by(F.struct("request", "answer"), "request").alias("r")).select("asker", "r.request", "r.answer")

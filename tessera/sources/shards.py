"""Advisory shards as a data source: lazy shard choice on reading, commit on writing.

A mirror's folder holds generations (``data/<generation>``) and manifests
(``manifests/<number>.json``), and the manifest with the largest number is the mirror.
Writers add files to a generation of their own; what each task wrote, with row counts
and digests, is known only from its commit message, and the manifest is written when
all tasks are done.  So files of failed or repeated attempts are in no manifest, and a
write that fails leaves the mirror as it was.

A reader plans from the manifest alone: filters on ``kind`` and ``ecosystem`` choose the
shards, and chosen files are packed into partitions of up to ``packBytes`` (a larger
file is one of its own).  A file that is gone, changed or no Parquet
is a row with its ``problem`` and no advisory; it is never an empty shard.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.advisories import AFFECTED
from ..shipping import ship
from ..storage import file_system

FORMAT = "advisory_shards"
KEYS = ("kind", "ecosystem")
SCHEMA = f"source string, kind string, ecosystem string, name string, id string, aliases array<string>, summary string, affected {AFFECTED}"


def newest(folder: str) -> dict | None:
    """The manifest in force, or None where none was ever written."""
    from pyarrow import fs

    store, root = file_system(folder)
    found = store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    return json.loads(store.open_input_stream(names[-1]).read()) if names else None


def publish(folder: str, generation: str, extra: dict | None = None) -> int:
    """Put a finished generation in force: the manifest is complete before it gets its name.  Returns its number."""
    store, root = file_system(folder)
    listed = json.loads(store.open_input_stream(f"{root}/data/{generation}/shards.json").read())
    was = newest(folder)
    number = 1 + (was["number"] if was else 0)
    body = json.dumps({**(extra or {}), "number": number, "generation": generation, "shards": listed}, sort_keys=True, indent=1)
    store.create_dir(f"{root}/manifests", recursive=True)
    part = f"{root}/manifests/{number:012d}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(body.encode())
    store.move(part, f"{root}/manifests/{number:012d}.json")
    return number


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: a list of (kind, ecosystem, path, rows, bytes, sha256)."""

    files: list[dict] = field(default_factory=list)


class Shard(InputPartition):
    """Files that are read by one task."""

    def __init__(self, entries: list[dict]) -> None:
        super().__init__(entries[0]["path"])
        self.entries = entries


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, generation: str | None, schema: StructType, pack: int) -> None:
        self.folder, self.generation, self.schema, self.pack = folder, generation, schema, pack
        self.asked: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Equality and IN on a shard's keys choose shards; every other filter stays Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                key = f.attribute[0]
                self.asked[key] = self.asked[key] & values if key in self.asked else values
            else:
                yield f

    def partitions(self) -> list[Shard]:
        if self.generation:
            store, root = file_system(self.folder)
            listed = json.loads(store.open_input_stream(f"{root}/data/{self.generation}/shards.json").read())
        else:
            found = newest(self.folder)
            if found is None:
                raise FileNotFoundError(f"{self.folder} has no manifest")
            listed = found["shards"]
        packs: list[list[dict]] = []
        room = -1
        for s in listed:
            if any(s[k] not in values for k, values in self.asked.items()):
                continue
            room -= s["bytes"]
            if room < 0:
                packs.append([])
                room = self.pack - s["bytes"]
            packs[-1].append(s)
        return [Shard(p) for p in packs]

    def read(self, partition: Shard | None) -> Iterator:
        for entry in partition.entries if partition else []:  # None: no shard was chosen
            yield from self.file(entry)

    def file(self, entry: dict) -> Iterator:
        """The rows of one file, or the row of its problem."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        store, root = file_system(self.folder)
        path, problem = f"{root}/{entry['path']}", None
        try:
            digest = hashlib.sha256()
            with store.open_input_stream(path) as raw:
                while block := raw.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != entry["sha256"]:
                problem = "the shard is not what was written"
        except FileNotFoundError:
            problem = "the shard is absent"
        if problem is None:
            with store.open_input_file(path) as raw:
                for b in pq.ParquetFile(raw).iter_batches(4096):
                    t = pa.Table.from_batches([b])
                    t = t.append_column("problem", pa.nulls(len(b), pa.string()))
                    yield from t.select(shape.names).cast(shape).to_batches()
        else:
            row = {"kind": entry["kind"], "ecosystem": entry["ecosystem"], "problem": problem}
            yield pa.RecordBatch.from_pylist([row], schema=shape)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, generation: str, in_force: bool) -> None:
        self.folder, self.generation, self.in_force = folder, generation, in_force

    def write(self, iterator: Iterator) -> Written:
        """Files of this task: a new one whenever the shard changes, so rows sorted by shard give one a shard."""
        import pyarrow.parquet as pq

        store, root = file_system(self.folder)
        store.create_dir(f"{root}/data/{self.generation}", recursive=True)
        files: list[dict] = []
        at, writer = None, None

        def close() -> None:
            writer.close()
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(f"{root}/{files[-1]['path']}") as raw:
                while block := raw.read(1 << 20):
                    digest.update(block)
                    size += len(block)
            files[-1].update(bytes=size, sha256=digest.hexdigest())

        for b in iterator:
            columns = [b.column(b.schema.get_field_index(k)).to_pylist() for k in KEYS]
            keys = list(zip(*columns, strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if keys[start] != at:
                    if writer:
                        close()
                    at = keys[start]
                    path = f"data/{self.generation}/{uuid.uuid4().hex}.parquet"
                    files.append({"kind": at[0], "ecosystem": at[1], "path": path, "rows": 0})
                    writer = pq.ParquetWriter(f"{root}/{path}", b.schema, filesystem=store, compression="zstd")
                writer.write_batch(b.slice(start, i - start))
                files[-1]["rows"] += i - start
                start = i
        if writer:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """List what all tasks wrote, and put it in force unless more belongs to the generation."""
        store, root = file_system(self.folder)
        listed = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["kind"] or "", f["ecosystem"] or "", f["path"]))
        store.create_dir(f"{root}/data/{self.generation}", recursive=True)
        with store.open_output_stream(f"{root}/data/{self.generation}/shards.json") as out:
            out.write(json.dumps(listed).encode())
        if self.in_force:
            publish(self.folder, self.generation)

    def abort(self, messages: list[Written | None]) -> None:
        """The generation goes; no manifest names it."""
        from pyarrow import fs

        store, root = file_system(self.folder)
        if store.get_file_info(f"{root}/data/{self.generation}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/data/{self.generation}")


class ShardSource(DataSource):
    """``spark.read/write.format("advisory_shards")``; options ``path``, ``generation`` (else the one in force), ``publish``, ``packBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{SCHEMA}, problem string"

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("generation"), schema, int(self.options.get("packBytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        if not overwrite:
            raise ValueError("a mirror is replaced as a whole: mode overwrite")
        return ShardWriter(self.options["path"], self.options.get("generation") or uuid.uuid4().hex, self.options.get("publish", "true") == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    ship(spark)
    spark.dataSource.register(ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""WARC archives with dictionary-compressed records.

A Zstandard dictionary is built from a bounded sample of the records, stands in each
archive's leading skippable frame, and every record is a frame of its own.  Records of
equal payloads of at least ``least`` bytes are stored once: the one with the smallest
page_id as a response, the others as revisits of it.

Archives go to a folder that driver and executors share.  A task names its archive
uniquely and reports the name with its result, so what a lost or repeated task has
left behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, ship

SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ID = re.compile(r"<urn:x-page:(-?\d*)>")
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One whole record; a revisit (``refers_to`` given) holds the HTTP head only."""
    revisit = refers_to is not None
    head = RESPONSE_HEAD % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names) and the payload; None for a revisit's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(found["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    found["payload"] = rest[:size].partition(b"\r\n\r\n")[2] if found["warc-type"] == "response" else None
    return found


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ArchiveWriter:
    """Writes the dictionary frame, then a frame for each record."""

    def __init__(self, out, dictionary: bytes, level: int = 3) -> None:
        self.out = out
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))

    def add(self, record: bytes) -> None:
        self.out.write(self.zip.compress(record))


def read_records(source, step: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one at a time, whatever its size."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size)))
    data = source.read(step)
    while data:
        frame, parts = unzip.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or source.read(step)
                break
            data = source.read(step)
            if not data:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def open_store(folder: str):
    """(file system, path) of a folder's address, of any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for what is stored in full).

    A null id ranks last; rows that repeat the page_id and payload of a response are
    responses too.  Firsts are found over ids and digests alone; payloads are then
    joined by page_id and digest, so copies of one payload never stand together.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = materialise(pages.select("page_id", F.octet_length(payload).alias("n"), F.unhex(F.sha2(payload, 256)).alias("d")), "digests").where(F.col("n") >= least)
    firsts = slim.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").select("d", "first")
    refers = slim.select("page_id", "d").join(firsts, "d").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    refers = refers.select(F.col("page_id").alias("__page"), "d", "first")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    joined = rows.join(refers, (F.unhex("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("__page")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def dictionary_sample(pages: DataFrame, sample: int, sample_bytes: int) -> list[bytes]:
    """Records of the first ``sample_bytes`` of ``sample`` pages with the smallest hash of id, url and length.

    Only rows under a limit that about twice ``sample`` rows pass leave their tasks,
    repeated ones once, so what the driver gets does not grow with the table.
    """
    clipped = pages.where("html IS NOT NULL").select("page_id", "url", F.encode(F.substr("html", F.lit(1), F.lit(sample_bytes)), "UTF-8").alias("body"), F.shiftrightunsigned(F.xxhash64("page_id", "url", F.length("html")), 1).alias("h"))
    n = pages.where("html IS NOT NULL").count()
    if n > 2 * sample:
        clipped = clipped.where(F.col("h") < F.lit(int(2**63 * (2 * sample / n))).cast("long"))
    once = clipped.groupBy("h").agg(F.min(F.struct("page_id", "url", "body")).alias("r")).orderBy("h").limit(sample).select("r.*")
    return [build_record(r["page_id"], r["url"], bytes(r["body"]), hashlib.sha256(r["body"]).hexdigest(), None) for r in once.collect()]


def write_archives(pages: DataFrame, folder: str, *, least: int = 100, sample: int = 256, sample_bytes: int = 16 << 10, level: int = 3) -> DataFrame:
    """Write the records of ``pages`` (page_id, url, html); returns (archive, n_records), already written.

    One archive a partition, none for an empty one.  The dictionary is built from the
    first ``sample_bytes`` of ``sample`` pages (:func:`dictionary_sample`).  A null html is an empty payload; other columns are not read.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    ship(spark)
    dictionary = train_dictionary(dictionary_sample(pages, sample, sample_bytes))
    open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import warc

        store, root = warc.open_store(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.zst", None, 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = warc.ArchiveWriter(out, dictionary, level)
                archive.add(warc.build_record(page, url, payload, digest, refers))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "n_records"])

    written = with_revisits(pages, least).mapInArrow(run, "archive string, n_records long")
    return materialise(written, "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is worked out from its stored payload and must be the one that
    its header states; a revisit has its payload's digest and length in its header.
    """
    import pyarrow as pa

    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import warc

        store, root = warc.open_store(folder)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with store.open_input_stream(f"{root}/{name}") as source:
                    for data in warc.read_records(source):
                        r = warc.parse_record(data)
                        page, refers = (warc._ID.fullmatch(r.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                        digest, size = r["warc-payload-digest"].removeprefix("sha256:"), int(r["x-payload-length"])
                        if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"])) != (digest, size):
                            raise ValueError(f"a payload in {name} is not what its header states")
                        rows.append((int(page[1]) if page[1] else None, size, digest, r["warc-type"], int(refers[1]) if refers else None))
                        n += 1
                        if len(rows) == 5000:
                            yield made(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{name} has {n} records, not {expected}")
                yield made(rows)

    return archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back, a row per record."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)

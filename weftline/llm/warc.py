"""WARC archives: writing, reading, and resolution of revisits.

Archives are written by executors as gzip members, one a record, through the Arrow file system of the shared
folder, a new file for each task attempt; a task returns index rows (file, offset and header fields) for files
that it has closed, and only files named in a committed index are ever read, so lost executors and retries do
no harm. Revisit resolution shuffles these index rows, never payloads: the record with the largest key among
the responses of a payload digest stays the response, all other records of the digest are joined to it and
become revisits, and each archive is then rewritten from itself with fresh headers.

Defined results: a null page is an empty payload; payloads below min_bytes are never revisits; equal keys with
equal payloads (repeated rows) give one response, and the rest revisit it; a null key is below all others; a
revisit record whose digest has no response stays a revisit without a reference; control characters in a URL
are escaped; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encode import text_slices
from weftline.session import materialize, new_path

#: Payload bytes and records after which a new archive begins.
ARCHIVE_BYTES = 64_000_000
ARCHIVE_RECORDS = 50_000
LEVEL = 3
#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, record_id string, key long, url string, date string, record_type string, digest string, payload_bytes long, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {_clean(str(value))}\r\n" for name, value in fields if value is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    at, size = cut + 4, int(fields["content-length"])
    if len(raw) < at + size:
        raise ValueError("a record is cut short")
    return fields, raw[at : at + size]


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and the payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")


def members(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file."""
    fs, local = FileSystem.from_uri(path)
    with fs.open_input_stream(local, compression=None) as stream:
        at, pending = 0, b""
        while pending or (pending := stream.read(1 << 20)):
            unzip, parts, start = zlib.decompressobj(31), [], at
            while True:
                parts.append(unzip.decompress(pending))
                at += len(pending) - len(unzip.unused_data)
                if unzip.eof:
                    pending = unzip.unused_data
                    break
                if not (pending := stream.read(1 << 20)):
                    raise ValueError(f"{path} ends within a record")
            yield start, b"".join(parts)


class Archive:
    """A new archive in a folder; add() gives a record's offset."""

    def __init__(self, folder: str):
        fs, local = FileSystem.from_uri(folder)
        fs.create_dir(local, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.at, self.payload, self.records = f"{folder}/{name}", 0, 0, 0
        self.stream = fs.open_output_stream(f"{local}/{name}", compression=None)
        self.add([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", 0)

    def add(self, fields: list[tuple[str, object]], block: bytes, payload: int) -> int:
        zip_ = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = zip_.compress(record_bytes(fields, block)) + zip_.flush()
        self.stream.write(data)
        start, self.at = self.at, self.at + len(data)
        self.payload, self.records = self.payload + payload, self.records + 1
        return start

    def full(self) -> bool:
        return self.payload >= ARCHIVE_BYTES or self.records >= ARCHIVE_RECORDS

    def close(self) -> None:
        self.stream.close()


def _fields(kind: str, record_id: str, key, url, date: str, digest: str, size: int) -> list[tuple[str, object]]:
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Key", key), ("X-Payload-Length", size),
    ]


def write_captures(pages: DataFrame, key: str, url: str, payload: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a response record for each row; gives the committed index."""
    folder = new_path(pages.sparkSession, "captures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, rows = None, []
        for batch in text_slices(batches, 256):
            for k, u, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(folder)
                body = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
                digest, record_id = payload_digest(body), f"<urn:uuid:{uuid.uuid4()}>"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                at = archive.add(_fields("response", record_id, k, u, date, digest, len(body)), head + body, len(body))
                rows.append((archive.path, at, record_id, k, u, date, "response", digest, len(body), None))
                if archive.full():
                    archive.close()
                    yield _index(rows)
                    archive, rows = None, []
        if archive:
            archive.close()
            yield _index(rows)

    index = pages.select(F.col(key).cast("long"), F.col(url), F.col(payload)).mapInArrow(run, INDEX)
    return materialize(index, "capture-index")


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def resolve(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds to each index row new_type and the original's original_key, original_id, original_url, original_date.

    Index rows meet by payload digest: the largest key is found with partial aggregation and written, and rows are
    joined to it; a hot digest is an oversized partition of a plain join, which adaptive execution splits.
    """
    able = index.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    best = F.max(F.struct("key", "record_id", "url", "date")).alias("original")
    originals = materialize(able.groupBy("digest").agg(best).withColumnRenamed("digest", "original_digest"), "originals")
    joined = index.join(originals, (F.col("digest") == F.col("original_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    kept = F.col("original").isNull() | (F.col("original.record_id") == F.col("record_id"))
    other = lambda c: F.when(~kept, F.col(f"original.{c}"))
    return joined.select(
        *index.columns,
        F.when(kept, F.col("record_type")).otherwise("revisit").alias("new_type"),
        other("key").alias("original_key"), other("record_id").alias("original_id"),
        other("url").alias("original_url"), other("date").alias("original_date"),
    )


def write_resolved(resolved: DataFrame) -> DataFrame:
    """Rewrites every archive of the index with fresh headers; gives one row (file, records) for each new archive.

    The rows of one archive, bounded by ARCHIVE_RECORDS, meet in a task, which reads that archive record by record.
    """
    folder = new_path(resolved.sparkSession, "archives")

    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        todo = {r["offset"]: r for r in rows.to_dict("records")}
        none = lambda x: None if x is None or x != x else x
        archive = Archive(folder)
        for at, raw in members(rows["file"].iloc[0]):
            if (row := todo.get(at)) is None:
                continue
            fields, block = parse_record(raw)
            head, payload = http_payload(block)
            key, size = none(row["key"]), int(row["payload_bytes"])
            fresh = _fields(row["new_type"], row["record_id"], None if key is None else int(key), none(row["url"]), row["date"], row["digest"], size)
            if row["new_type"] == "revisit":
                fresh.append(("WARC-Profile", PROFILE))
                if none(row["original_id"]) is not None:
                    original = none(row["original_key"])
                    fresh += [("WARC-Refers-To", row["original_id"]), ("WARC-Refers-To-Target-URI", none(row["original_url"])), ("WARC-Refers-To-Date", row["original_date"]), ("X-Refers-To-Key", None if original is None else int(original))]
                archive.add(fresh, head, 0)
            else:
                archive.add(fresh, block, len(payload))
        archive.close()
        return pd.DataFrame({"file": [archive.path], "records": [len(todo)]})

    cols = ["file", "offset", "record_id", F.col("key").cast("decimal(20,0)").alias("key"), "url", "date", "digest", "payload_bytes", "new_type", F.col("original_key").cast("decimal(20,0)").alias("original_key"), "original_id", "original_url", "original_date"]
    return materialize(resolved.select(*cols).groupBy("file").applyInPandas(rewrite, "file string, records long"), "archive-list")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Index rows of all records of the archives named in `file`; digests and sizes of payloads in the archive are computed from them.

    A payload that does not match its record's digest raises an error.
    """
    schema = INDEX + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, held = [], 0
            for at, raw in members(path):
                fields, block = parse_record(raw)
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_payload(block)
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                size = number("x-payload-length")
                if kind == "response":
                    size = len(payload)
                    if payload_digest(payload) != said:
                        raise ValueError(f"{path} at {at}: the payload does not match its digest")
                row = (path, at, fields["warc-record-id"], number("x-key"), fields.get("warc-target-uri"), fields["warc-date"], kind, said, size, number("x-refers-to-key"))
                rows.append((*row, payload) if with_payload else row)
                held += len(payload) if with_payload else 0
                if len(rows) >= 5000 or held >= 16_000_000:
                    yield _batch(rows, with_payload)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, with_payload)

    return files.select("file").mapInArrow(run, schema)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types, names = (_TYPES + [pa.binary()], _NAMES + ["payload"]) if with_payload else (_TYPES, _NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def deduplicated_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """The list of archives (file, records) that hold pages with revisits resolved."""
    return write_resolved(resolve(write_captures(pages, key, url, payload), min_bytes))


def spread(files: DataFrame, spark: SparkSession) -> DataFrame:
    """The list with a file for each task."""
    n = max(1, files.count())
    return files.repartition(n, "file") if n > 1 else files

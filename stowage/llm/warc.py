"""WARC archives: written with payloads deduplicated, and read back record by record.

Each record is a gzip member of its own. The reader takes an archive in order, a block of compressed
bytes at a time: it inflates one member, frames the record by its Content-Length, and verifies the
digests of block and payload before it hands the record on.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the
response; the others are revisits, which keep the HTTP header with the payload's length but no payload.

Archives go to a folder that all executors share, by any file system that Arrow can open. A task's
archives have names of their own; only those of tasks that ended are listed and read, so a repeated
task leaves at most a file that nothing refers to.

Defined results: a null html is an empty payload; a null url is recorded as empty; rows that share the
largest page_id of a payload are all responses; a null page_id never is the largest if there is
another; a payload of any length is one record, held whole by one task; an empty table gives no
archives and an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written, new_path

#: Equal payloads of so many bytes at least are stored once.
LEAST = 0
#: An archive is closed when it has so many compressed bytes.
ARCHIVE_BYTES = 256_000_000
#: Compressed bytes read at a time.
READ = 1 << 16
#: Written to every record; a fixed date keeps reruns equal.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value in one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class DamagedArchive(ValueError):
    """An archive breaks off, or a record doesn't hold what its header says."""


def members(source, read: int = READ) -> Iterator[Iterator[bytes]]:
    """The gzip members of a byte stream, each as an iterator over its inflated bytes; the caller uses up one before the next."""
    rest = source.read(read)
    while rest:
        inflate = zlib.decompressobj(31)

        def parts():
            nonlocal rest
            while not inflate.eof:
                if not rest and not (rest := source.read(read)):
                    raise DamagedArchive("the archive ends within a record")
                part = inflate.decompress(rest, 4 * read)
                rest = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
                if part:
                    yield part

        yield parts()
        if not inflate.eof:
            raise DamagedArchive("a record was not read to its end")
        rest = rest or source.read(read)


class _Framed:
    """The bytes of one member, taken from its parts as they are inflated."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, bytearray()

    def until(self, mark: bytes) -> bytes:
        """What comes before `mark`, which is taken too."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if (part := next(self.parts, None)) is None:
                raise DamagedArchive("a record has no end of header")
            self.held += part
        found = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return found

    def exactly(self, n: int, who: str) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.held:
                if (part := next(self.parts, None)) is None:
                    raise DamagedArchive(f"{who} lacks {n} bytes")
                self.held += part
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def read_records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names in lower case), HTTP header and payload of each record of an archive, verified.

    A record is framed by its Content-Length while it is inflated: a longer or a shorter member is an error, found without inflating more than the record and the block behind it.
    """
    for parts in members(source):
        record = _Framed(parts)
        version, *lines = record.until(b"\r\n\r\n").decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise DamagedArchive(f"a record begins with {version[:20]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        who, digest, held = head.get("warc-record-id", "a record"), hashlib.sha1(), []
        for part in record.exactly(int(head["content-length"]), who):
            digest.update(part)
            held.append(part)
        if b"".join(record.exactly(4, who)) != b"\r\n\r\n" or record.held or next(parts, None) is not None:
            raise DamagedArchive(f"{who} doesn't end after {head['content-length']} bytes")
        block = b"".join(held)
        if head.get("warc-block-digest", "").partition(":")[2] != base64.b32encode(digest.digest()).decode():
            raise DamagedArchive(f"{who}: the block has another digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["warc-type"] == "response" and head["warc-payload-digest"].partition(":")[2] != base32_sha1(payload):
            raise DamagedArchive(f"{who}: the payload has another digest")
        yield head, http, payload


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each of `pages` (page_id, url, html). archive and records, a row for each archive."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # Written, so that the join deals the pages anew and a payload with very many of them can be split there.
    equal = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(Written(equal, "warc-equal").df, "digest", "left")
    revisit = (F.length("payload") >= least) & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    rows = rows.select("page_id", "url", "payload", "first", revisit.alias("revisit"))

    def run(batches):
        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, done, out, size, records = TaskContext.get().partitionId(), [], None, 0, 0
        for batch in batches:
            for page_id, url, payload, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{task:05d}-{len(done):05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = record(page_id, url, payload, first, again)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records"])

    return Written(rows.mapInArrow(run, "archive string, records long"), "warc-index").df


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, stored_bytes."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, stored_bytes long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        urn = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for head, http, payload in read_records(source):
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        kind = head["warc-type"]
                        if kind == "response" and length != len(payload):
                            raise DamagedArchive(f"{head['warc-record-id']}: the payload has {len(payload)} bytes, not {length}")
                        out.append((urn(head["warc-record-id"]), length, head["warc-payload-digest"].partition(":")[2], kind, urn(head.get("warc-refers-to")), head.get("warc-target-uri"), len(payload)))
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # One archive is one task's work: an archive can't be split, and is of bounded size.
    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism * 2)
    return archives.select("archive").repartition(spread, "archive").mapInArrow(run, schema)


def warc_table(pages: DataFrame) -> DataFrame:
    """The digest columns, a row for each of `pages`, from the archives as read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)

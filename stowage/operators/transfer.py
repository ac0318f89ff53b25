"""Uploads and downloads that act: files of a working copy to the objects of a store and back, each in one task.

Objects lie below a folder that all executors see, by any file system that Arrow opens. A file's stem is
prefix/assets/hash/path; behind it stand .gz if it is compressed and .chunkN if it has more than
`chunk_size` stored bytes. Objects and files are written under another name and then take their own, so a
lost task leaves nothing that looks whole. What was done comes back as a relation, from which dml.publish()
and store.verify() make the next manifest and the report.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.content import SAMPLE, WORTH

#: Bytes of a chunk, less one; bytes read at a time.
CHUNK_SIZE, BLOCK = 8 << 20, 1 << 20
_UPLOADED = "path string, hash string, objects int, bytes long, sent int, landed boolean, error string"
_UPLOADED_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
_DOWNLOADED = "path string, hash string, bytes long, ok boolean, error string"
_DOWNLOADED_TYPES = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())


def _row_batch(rows: list[tuple], schema: str, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _blocks(source, size: int = BLOCK) -> Iterator[bytes]:
    while data := source.read(size):
        yield data


def _compressed(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip stream without name and time, so that equal files give equal objects."""
    squeeze = zlib.compressobj(5, zlib.DEFLATED, -15)
    check, size = 0, 0
    yield b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    for data in blocks:
        check, size = zlib.crc32(data, check), size + len(data)
        yield squeeze.compress(data)
    yield squeeze.flush() + check.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little")


def _worth_compressing(path: str) -> bool:
    with open(path, "rb") as f:
        sample = f.read(SAMPLE)
    return bool(sample) and len(gzip.compress(sample, 1)) < WORTH * len(sample)


def _put(fs, key: str, blocks: Iterator[bytes]) -> int:
    held, n = f"{key}.{uuid.uuid4().hex}.tmp", 0
    fs.create_dir(os.path.dirname(key), recursive=True)
    with fs.open_output_stream(held, compression=None) as out:
        for data in blocks:
            out.write(data)
            n += len(data)
    fs.move(held, key)
    return n


def _pieces(blocks: Iterator[bytes], size: int) -> Iterator[Iterator[bytes]]:
    """A stream cut into streams of `size` bytes; each must be used up before the next."""
    rest = next(blocks, b"")

    def piece():
        nonlocal rest
        left = size
        while rest and left:
            part, rest = rest[:left], rest[left:]
            left -= len(part)
            yield part
            while not rest and (more := next(blocks, None)) is not None:
                rest = more

    while rest:
        yield piece()


def _stat(path: str) -> tuple:
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns, s.st_ino


def upload(files: DataFrame, root: str, store: str, prefix: str, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Send the files (path) below `root`: path, hash, the number and bytes of their objects, how many were sent, and whether all landed.

    A file whose objects are all there with their sizes is not sent again. One that changes while it is read has not
    landed, nor one that can't be read; `error` says why.
    """

    def send(fs, base: str, path: str) -> tuple:
        full = os.path.join(root, path)
        before = _stat(full)
        with open(full, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        packed = _worth_compressing(full)
        stem = f"{base}/{prefix}/assets/{digest}/{path}" + ".gz" * packed
        size = before[0]
        if packed:
            with open(full, "rb") as f:
                size = sum(map(len, _compressed(_blocks(f))))
        sizes = [size] if size <= chunk_size else [min(chunk_size - 1, size - k) for k in range(0, size, chunk_size - 1)]
        names = [stem] if len(sizes) == 1 else [f"{stem}.chunk{k}" for k in range(len(sizes))]
        there = [x.is_file and x.size == n for x, n in zip(fs.get_file_info(names), sizes, strict=True)]
        if not all(there):
            with open(full, "rb") as f:
                stream = _compressed(_blocks(f)) if packed else _blocks(f)
                parts = [stream] if len(names) == 1 else _pieces(stream, chunk_size - 1)
                for name, part, held in zip(names, parts, there, strict=True):
                    if held:
                        for _ in part:
                            pass
                    else:
                        _put(fs, name, part)
        same = _stat(full) == before
        return path, digest, len(names), size, there.count(False), same, None if same else "changed while it was read"

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(store)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append(send(fs, base, path))
                except OSError as e:
                    rows.append((path, None, 0, 0, 0, False, str(e)))
            if rows:
                yield _row_batch(rows, _UPLOADED, _UPLOADED_TYPES)

    return _dealt(files.select("path")).mapInArrow(run, _UPLOADED)


def download(located: DataFrame, store: str, root: str, prefix: str) -> DataFrame:
    """Fetch files (path, hash, state, form, chunked, parts: store.locate() of a manifest with its hashes): path, hash, bytes and whether the digest of the whole file was right.

    Objects are read in order, block by block, to a file beside the one that they are to be, which it replaces only
    if the digest is the entry's.
    """

    def fetch(fs, base: str, target: str, row: dict) -> tuple:
        path, wanted = row["path"], row["hash"]
        if row["state"] != "ok":
            return path, wanted, 0, False, f"the stored object is {row['state']}"
        stem = f"{base}/{prefix}/assets/{wanted}/{path}" + (".gz" if row["form"] == "gz" else "")
        names = [f"{stem}.chunk{k}" for k in range(row["parts"])] if row["chunked"] else [stem]
        full = os.path.join(target, path)
        os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
        held, digest, n = f"{full}.{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0
        inflate = zlib.decompressobj(31) if row["form"] == "gz" else None
        try:
            with open(held, "wb") as out:
                for name in names:
                    with fs.open_input_stream(name, compression=None) as source:
                        for data in _blocks(source):
                            data = inflate.decompress(data) if inflate else data
                            digest.update(data)
                            out.write(data)
                            n += len(data)
            if inflate and not inflate.eof:
                return path, wanted, n, False, "the stored object breaks off"
            if digest.hexdigest() != wanted:
                return path, wanted, n, False, f"its digest is {digest.hexdigest()}"
            os.replace(held, full)
            return path, wanted, n, True, None
        finally:
            if os.path.exists(held):
                os.unlink(held)

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(store)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append(fetch(fs, base, root, row))
                except (OSError, zlib.error) as e:
                    rows.append((row["path"], row["hash"], 0, False, str(e)))
            if rows:
                yield _row_batch(rows, _DOWNLOADED, _DOWNLOADED_TYPES)

    return _dealt(located.select("path", "hash", "state", "form", "chunked", "parts")).mapInArrow(run, _DOWNLOADED)


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, F.col("path"))

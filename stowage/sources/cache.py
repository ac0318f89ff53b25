"""The hash cache and the registry of claims as files: damage reads as empty, and only changes are written.

A cache is read in tasks, never on the driver: by ranges of its bytes where it has an entry a line, as
it is written here, and otherwise as a stream of entries in one task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import ship
from stowage.sources.manifest import is_yaml, write_document

_CACHE = "path string, hash string, size long, mtime double, inode long, timestamp double"
_CLAIMS = "base string, claimed_at double"
#: Bytes of a cache file for a task, entries in a batch, and characters of a JSON stream that are read at once.
_RANGE, _BATCH, _PIECE = 4 << 20, 5000, 1 << 20
#: An escape of YAML; those of eight digits are two in JSON.
_ESCAPE = re.compile(r"\\(?:U([0-9a-fA-F]{8})|.)")
#: What a row read is: an entry, a value that is none, or the sign that the document is damaged.
_ENTRY, _OTHER, _DAMAGE = 0, 1, 2


def _document(path: str) -> dict:
    """The mapping that a file holds; an empty one where it is missing, damaged or anything else."""
    try:
        with open(path) as f:
            if is_yaml(path):
                import yaml

                found = yaml.load(f, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            else:
                found = json.load(f)
    except Exception:
        return {}
    return found if isinstance(found, dict) else {}


def _narrow(found: re.Match) -> str:
    return found[0] if found[1] is None else json.dumps(chr(int(found[1], 16)))[1:-1]


def _line(line: bytes, yaml_text: bool, last: bool) -> tuple[object, object]:
    """The entry of a line as write_document() writes it; ValueError for any other."""
    text = line.decode("ascii").rstrip("\r\n")
    if yaml_text:
        text = _ESCAPE.sub(_narrow, text) if "\\U" in text else text
    elif not last:
        if not text.endswith(","):
            raise ValueError(text)
        text = text[:-1]
    decoder = json.JSONDecoder()
    key, at = decoder.raw_decode(text)
    if not (isinstance(key, str) or key is None and yaml_text) or text[at : at + 2] != ": ":
        raise ValueError(text)
    value, end = decoder.raw_decode(text, at + 2)
    if end < len(text):
        raise ValueError(text)
    return key, value


def _lines(path: str, first: int, end: int) -> Iterator[tuple[int, object, object]]:
    """Where each line begins that does so in a range, with its key and value."""
    with open(path, "rb") as f:
        # Braces on lines of their own enclose the entries of JSON.
        body, close = (0, os.path.getsize(path)) if is_yaml(path) else (2, os.path.getsize(path) - 2)
        f.seek(max(first - 1, body))
        if first > body:
            f.readline()
        while (at := f.tell()) < min(end, close):
            line = f.readline()
            yield at, *_line(line, is_yaml(path), f.tell() >= close)


def _by_lines(path: str) -> bool:
    """Whether a file begins and ends as one with an entry a line."""
    with open(path, "rb") as f:
        first = f.read(2)
        f.seek(max(0, os.path.getsize(path) - 3))
        last = f.read()
    return last.endswith(b"\n") and first[:1] in b'"n' if is_yaml(path) else first == b"{\n" and last == b"\n}\n"


def _json_entries(path: str) -> Iterator[tuple[object, object]]:
    """The entries of a JSON object, read piece by piece; ValueError for anything else."""
    decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")
    with open(path) as f:
        held, at, ended = "", 0, False

        def more() -> None:
            nonlocal held, at, ended
            piece = f.read(max(_PIECE, len(held) - at))
            held, at, ended = held[at:] + piece, 0, not piece

        def mark() -> str:
            """The next character that isn't blank; none at the end."""
            nonlocal at
            while (at := blank.match(held, at).end()) == len(held) and not ended:
                more()
            return held[at : at + 1]

        def take(one_of: str) -> str:
            nonlocal at
            if not (found := mark()) or found not in one_of:
                raise ValueError(f"one of {one_of} is lacking")
            at += 1
            return found

        def value() -> object:
            nonlocal at
            mark()
            while True:
                try:
                    found, end = decoder.raw_decode(held, at)
                except ValueError:
                    if ended:
                        raise
                else:
                    # A number at the end of a piece may go on.
                    if ended or end < len(held):
                        at = end
                        return found
                more()

        take("{")
        if mark() == "}":
            take("}")
        else:
            sign = ","
            while sign == ",":
                key = value()
                if not isinstance(key, str):
                    raise ValueError("a key is no string")
                take(":")
                yield key, value()
                sign = take(",}")
        if mark():
            raise ValueError("more than a mapping")


def _yaml_entries(path: str) -> Iterator[tuple[object, object]]:
    """The entries of a YAML mapping, composed one by one from its events; ValueError or YAMLError for anything else."""
    import yaml

    with open(path) as f:
        loader, anchors = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(f), {}

        def node(event):
            if isinstance(event, yaml.AliasEvent):
                return anchors[event.anchor]
            kind = {yaml.ScalarEvent: yaml.ScalarNode, yaml.SequenceStartEvent: yaml.SequenceNode, yaml.MappingStartEvent: yaml.MappingNode}[type(event)]
            scalar = kind is yaml.ScalarNode
            tag = event.tag if event.tag not in (None, "!") else loader.resolve(kind, event.value if scalar else None, event.implicit)
            found = kind(tag, event.value if scalar else [], event.start_mark, event.end_mark)
            if event.anchor is not None:
                anchors[event.anchor] = found
            if not scalar:
                end = yaml.SequenceEndEvent if kind is yaml.SequenceNode else yaml.MappingEndEvent
                while not isinstance(inner := loader.get_event(), end):
                    found.value.append(node(inner) if kind is yaml.SequenceNode else (node(inner), node(loader.get_event())))
            return found

        loader.get_event()
        if isinstance(loader.get_event(), yaml.StreamEndEvent):
            return
        event = loader.get_event()
        if not isinstance(event, yaml.MappingStartEvent):
            raise ValueError("not a mapping")
        while not isinstance(event := loader.get_event(), yaml.MappingEndEvent):
            yield from loader.construct_document(yaml.MappingNode("tag:yaml.org,2002:map", [(node(event), node(loader.get_event()))], event.start_mark, event.end_mark)).items()
        loader.get_event()
        if not isinstance(loader.get_event(), yaml.StreamEndEvent):
            raise ValueError("more than a document")


def _cells(entry: dict) -> tuple:
    held = entry.get("metadata") or {}
    text, numbers = entry.get("hash"), [held.get("mtime"), entry.get("timestamp")]
    mtime, taken = (None if x is None else float(x) for x in numbers)
    return (None if text is None else str(text), held.get("size"), mtime, held.get("inode"), taken)


_SCHEMA = pa.schema([("at", pa.int64()), ("state", pa.int32()), ("path", pa.string()), ("hash", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("inode", pa.int64()), ("timestamp", pa.float64())])


def _batches(found: Iterator[tuple[int, object, object]]) -> Iterator[pa.RecordBatch]:
    """Batches of what is found; where that fails, a row that says so ends them."""
    try:
        while some := list(islice(found, _BATCH)):
            rows = [(at, _ENTRY, k if k is None else str(k), *_cells(v)) if isinstance(v, dict) else (at, _OTHER, k if k is None else str(k), *[None] * 5) for at, k, v in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
    except Exception:
        yield pa.RecordBatch.from_pylist([{"at": 0, "state": _DAMAGE}], schema=_SCHEMA)


def _kept(rows: DataFrame) -> DataFrame:
    """The rows as they are now, whatever becomes of the file."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    """What a cache file holds; nothing where it is damaged. Of entries with one path the last counts."""
    path = os.path.abspath(path)
    ship(spark)

    def by_lines(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from _batches(_lines(path, k * _RANGE, (k + 1) * _RANGE))

    def as_stream(batches):
        for batch in batches:
            if batch.num_rows:
                entries = _yaml_entries(path) if is_yaml(path) else _json_entries(path)
                yield from _batches((at, k, v) for at, (k, v) in enumerate(entries))

    schema = "at long, state int, " + _CACHE
    names = [x.split()[0] for x in _CACHE.split(", ")]
    parts = -(-os.path.getsize(path) // _RANGE)
    ways = [(by_lines, parts)] if parts and _by_lines(path) else []
    for read, tasks in [*ways, (as_stream, 1)]:
        found = _kept(spark.range(0, tasks, 1, tasks).mapInArrow(read, schema))
        if found.where(F.col("state") == _DAMAGE).isEmpty():
            last = found.groupBy("path").agg(F.max_by(F.struct("state", *names), "at").alias("last"))
            return last.where(F.col("last.state") == _ENTRY).select("last.*").drop("state")
    return spark.createDataFrame([], _CACHE)


class HashCache:
    """A cache file and the relation that it holds. It is read again only when its time has changed, and written only after a change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._read_at: int | None = None
        self.dirty = False
        self._rows = spark.createDataFrame([], _CACHE)

    def load(self, force: bool = False) -> DataFrame:
        """path, hash, size, mtime, inode and timestamp."""
        try:
            now = os.stat(self.path).st_mtime_ns
        except OSError:
            if self._read_at is not None:
                self._rows, self._read_at, self.dirty = self.spark.createDataFrame([], _CACHE), None, False
            return self._rows
        if force or now != self._read_at:
            self._rows, self._read_at, self.dirty = _read_cache(self.spark, self.path), now, False
        return self._rows

    def set(self, rows: DataFrame) -> None:
        """What the cache holds from now on, by an operator of dml."""
        self._rows, self.dirty = rows.select("path", "hash", "size", "mtime", "inode", "timestamp"), True

    def save(self) -> bool:
        """Write the file if anything has changed since it was read or written. Whether it was."""
        if not self.dirty:
            return False
        entries = ((r["path"], {"hash": r["hash"], "metadata": {k: r[k] for k in ("size", "mtime", "inode")}, "timestamp": r["timestamp"]}) for r in self._rows.orderBy("path").toLocalIterator())
        write_document(self.path, entries)
        self._read_at, self.dirty = os.stat(self.path).st_mtime_ns, False
        return True


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """base and claimed_at of a registry {claims: {base: time}}; a damaged one is empty, so that it never blocks an upload."""
    held = _document(path).get("claims")
    rows = [(k, float(v)) for k, v in held.items() if isinstance(v, (int, float))] if isinstance(held, dict) else []
    return spark.createDataFrame(rows, _CLAIMS)


def write_claims(claims: DataFrame, path: str) -> None:
    write_document(path, ((r["base"], r["claimed_at"]) for r in claims.groupBy("base").agg(F.max("claimed_at").alias("claimed_at")).orderBy("base").toLocalIterator()), under="claims")


def convert_cache(spark: SparkSession, source: str, target: str) -> None:
    """Write a cache in the other format; a target that exists stays as it is."""
    if os.path.exists(target):
        raise FileExistsError(target)
    cache = HashCache(spark, target)
    cache.set(HashCache(spark, source).load())
    cache.save()

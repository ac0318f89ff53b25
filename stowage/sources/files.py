"""Files of a working copy: listed, read and hashed by the executors, which must all see its root."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import globs, keys

_STAT = "path string, size long, mtime double, inode long"
_STAT_TYPES = (pa.string(), pa.int64(), pa.float64(), pa.int64())
#: Directories that the driver lists before the executors walk on from there, for each task; rows and bytes sent on at a time.
TOPS_A_TASK, ROWS, BYTES = 8, 5_000, 16_000_000


def _stat(root: str, full: str) -> tuple[str, int, float, int] | None:
    try:
        s = os.stat(full)
    except OSError:  # gone meanwhile, or a link to nothing
        return None
    return os.path.relpath(full, root).replace(os.sep, "/"), s.st_size, s.st_mtime, s.st_ino


def _batches(rows: Iterator[tuple], names: list[str], types, size) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if len(out) >= ROWS or held >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def list_files(spark: SparkSession, root: str, below: str = "", internal: bool = False) -> DataFrame:
    """path, size, mtime and inode of every file under `root`, hidden and empty ones among them.

    The driver lists directories level by level until there are enough of them; the executors walk each.
    """
    tasks = spark.sparkContext.defaultParallelism * 4
    start = os.path.join(root, below) if below else root
    level, files = ([start], []) if os.path.isdir(start) else ([], [start])
    while level and len(level) < TOPS_A_TASK * tasks:
        deeper = []
        for folder in level:
            with os.scandir(folder) as found:
                for x in found:
                    (deeper if x.is_dir(follow_symlinks=False) else files).append(x.path)
        level = deeper
        if len(files) > TOPS_A_TASK * tasks * 100:
            break
    tops = [(p, True) for p in level] + [(p, False) for p in files]

    def walk(batches):
        def rows():
            for batch in batches:
                for top, is_dir in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = ((f, names) for f, _, names in os.walk(top)) if is_dir else [(os.path.dirname(top), [os.path.basename(top)])]
                    for folder, names in found:
                        for name in names:
                            full = os.path.join(folder, name)
                            if os.path.isfile(full) and (row := _stat(root, full)):
                                yield row

        yield from _batches(rows(), ["path", "size", "mtime", "inode"], _STAT_TYPES, lambda r: len(r[0]))

    listed = spark.createDataFrame(tops, "top string, is_dir boolean").repartition(max(1, min(tasks, len(tops)))).mapInArrow(walk, _STAT)
    return listed if internal else listed.where(~keys.is_internal("path"))


def _visible(pattern: str) -> str:
    """The regular expression of a file pattern: as globs have it, but a wildcard doesn't take a name that begins with a dot."""
    out = []
    for part in pattern.split("/"):
        if part == "**":
            out.append("**")
        else:
            body = globs.compile_glob(part, "segment").removeprefix(r"\A").removesuffix(r"\z")
            out.append(body if part.startswith(".") or not globs.has_glob(part[:1]) else rf"(?!\.){body}")
    text = "/".join(out)
    text = text.replace("**/", r"(?:(?!\.)[^/]+/)*")
    return rf"\A{text.removesuffix('/**')}(?:/(?!\.)[^/]+)*\z" if text.endswith("/**") else r"\A(?!\.)[^/]+(?:/(?!\.)[^/]+)*\z" if text == "**" else rf"\A{text}\z"


def named_by(path: Column, pattern: str) -> Column:
    """Whether a pattern names a file, or a directory above it."""
    expression = _visible(pattern.rstrip("/"))
    return path.rlike(expression) | F.exists(keys.ancestors(path), lambda d: d.rlike(expression))


def resolve(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """The files that a user names: a file itself, all below a directory, else those that a pattern names with all below directories that it names; without internal ones."""
    if os.path.lexists(os.path.join(root, spec)):
        return list_files(spark, root, spec.rstrip("/"))
    # Only the part of the tree that the pattern begins with is walked.
    fixed = globs.literal_prefix(spec).rpartition("/")[0]
    if fixed and not os.path.isdir(os.path.join(root, fixed)):
        return spark.createDataFrame([], _STAT)
    return list_files(spark, root, fixed).where(named_by(F.col("path"), spec))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """`files` with their content; a file that has gone meanwhile is left out."""

    def read(batches):
        def rows():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        with open(os.path.join(root, row[0]), "rb") as f:
                            yield (*row, f.read())
                    except FileNotFoundError:
                        continue

        yield from _batches(rows(), ["path", "size", "mtime", "inode", "content"], (*_STAT_TYPES, pa.binary()), lambda r: len(r[-1]))

    return _spread(files.select("path", "size", "mtime", "inode")).mapInArrow(read, f"{_STAT}, content binary")


def hash_files(files: DataFrame, root: str, block: int = 1 << 20) -> DataFrame:
    """path and hash (SHA-256) of files, read block by block."""

    def run(batches):
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            yield path, hashlib.file_digest(f, "sha256").hexdigest()
                    except FileNotFoundError:
                        continue

        yield from _batches(rows(), ["path", "hash"], (pa.string(), pa.string()), lambda r: len(r[0]))

    return _spread(files.select("path")).mapInArrow(run, "path string, hash string")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt over tasks by path: what they weigh isn't in their rows."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path")


def inventory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key and size of the objects below a folder that stands for a store, whose keys begin with `prefix`. Only the folder that the prefix ends in is walked."""
    below = prefix.rpartition("/")[0]
    if below and not os.path.isdir(os.path.join(root, below)):
        return spark.createDataFrame([], "key string, size long")
    return list_files(spark, root, below, internal=True).selectExpr("path AS key", "size").where(F.col("key").startswith(prefix))

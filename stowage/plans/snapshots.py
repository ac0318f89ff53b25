"""Versioned manifests: shards in folders, a small file for each revision, and a pointer to the current one.

A write puts shards into a folder of its own. The file of a revision says in which folder each of its
shards is, so a revision of which few shards changed writes those only, and a reader lists no folder and
reads no shard that it isn't asked for. The number of shards is that of top-level directories.

A revision is written before the pointer moves to it, and the pointer moves only from the revision that
the writer has read: two writers can't both win. A move is one numbered file that holds its revision. It
is written under another name and then takes its own, so a writer that stops at any point leaves no move
half made. Taking a name that is taken must fail, as it does by rename on HDFS and by link on a local
disk; on an object store without such a rename, moves need a conditional write instead.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import keys
from stowage.sources import manifest

_SCHEMA = "path string, hash string, shard string"


class Conflict(RuntimeError):
    """Another writer has moved the pointer."""


class NoRevision(LookupError):
    """There is no such revision."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Small files -------------------------------------------------------------------------------

    def _text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        source = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def _make(self, path: str, text: str) -> bool:
        """Write a file that must be new, whole or not at all. Whether it was."""
        where, held = self._path(path), self._path(f"{self.root}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(where.getParent())
        out = self._fs.create(held, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                place = lambda p: self._jvm.java.io.File(self._fs.makeQualified(p).toUri()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(place(where), place(held))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return not self._fs.exists(where) and self._fs.rename(held, where)
        finally:
            self._fs.delete(held, False)

    # Revisions ----------------------------------------------------------------------------------

    def _shards_of(self, revision: str) -> dict[str, str] | None:
        """The folder of each shard."""
        text = self._text(f"{self.root}/revisions/{revision}.json")
        return None if text is None else json.loads(text)

    def _put(self, entries: DataFrame) -> dict[str, str]:
        """Write shards to a new folder. A large shard is dealt over several tasks, small ones share one, as Spark finds their sizes."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows = entries.select("path", "hash", keys.shard_for("path").alias("shard"))
        rows.hint("rebalance", "shard").sortWithinPartitions("shard", "path").write.partitionBy("shard").parquet(folder)
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if x.isDirectory()]
        return {unescape(x.partition("=")[2]): folder for x in names if x.startswith("shard=")}

    def _commit(self, revision: str, shards: dict[str, str]) -> None:
        if not self._make(f"{self.root}/revisions/{revision}.json", json.dumps(shards, sort_keys=True)):
            raise FileExistsError(revision)

    def write(self, entries: DataFrame, revision: str) -> None:
        """Write a revision; it must be new."""
        if self._shards_of(revision) is not None:
            raise FileExistsError(revision)
        self._commit(revision, self._put(entries))

    def read(self, revision: str, shards: list[str] | None = None) -> DataFrame | None:
        """path and hash of a revision, or None where there is no such revision. Only the named shards are read."""
        held = self._shards_of(revision)
        if held is None:
            return None
        folders: dict[str, list[str]] = {}
        for shard, folder in held.items():
            if shards is None or shard in shards:
                folders.setdefault(folder, []).append(shard)
        found = self.spark.createDataFrame([], "path string, hash string")
        for k, (folder, names) in enumerate(sorted(folders.items())):
            part = self.spark.read.schema(_SCHEMA).parquet(folder).where(F.col("shard").isin(names)).select("path", "hash")
            found = part if k == 0 else found.unionByName(part)
        return found

    def shards(self, revision: str) -> list[str]:
        """The shards of a revision, from its file alone."""
        held = self._shards_of(revision)
        if held is None:
            raise NoRevision(revision)
        return sorted(held)

    def write_changed(self, old: str, entries: DataFrame, new: str, changed: list[str]) -> None:
        """Write a revision of which only the shards in `changed` differ from `old`: those are written, for the others it points to where they are. A shard that is empty now is in no revision."""
        held = self._shards_of(old)
        if held is None:
            raise NoRevision(old)
        fresh = self._put(entries.where(keys.shard_for("path").isin(changed)))
        self._commit(new, {k: v for k, v in held.items() if k not in changed} | fresh)

    def shard_manifest(self, path: str, revision: str) -> None:
        """Write a revision from a manifest that is one file."""
        self.write(manifest.read_manifest(self.spark, path), revision)

    def unshard(self, revision: str, path: str, **settings) -> None:
        """Write a revision as a manifest that is one file."""
        found = self.read(revision)
        if found is None:
            raise NoRevision(revision)
        manifest.write_manifest(found, path, **settings)

    # Pointer --------------------------------------------------------------------------------------

    def _last(self) -> int:
        where = self._path(f"{self.root}/head")
        if not self._fs.exists(where):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(where)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def head(self) -> str | None:
        """The current revision: that of the last move."""
        last = self._last()
        return self._text(f"{self.root}/head/{last:012d}") if last else None

    def advance(self, expected: str | None, revision: str) -> None:
        """Move the pointer from `expected` to `revision`; Conflict if it stands elsewhere, or another writer makes the move first."""
        last = self._last()
        now = self._text(f"{self.root}/head/{last:012d}") if last else None
        if now != expected:
            raise Conflict(f"the current revision is {now}, not {expected}")
        if self._shards_of(revision) is None:
            raise NoRevision(revision)
        if not self._make(f"{self.root}/head/{last + 1:012d}", revision):
            raise Conflict(f"another writer has made move {last + 1}")

    def moves(self) -> DataFrame:
        """A stream of the revisions that the pointer moves to: move and revision. New ones are found by their files."""
        self._fs.mkdirs(self._path(f"{self.root}/head"))
        rows = self.spark.readStream.schema("value string").text(f"{self.root}/head", wholetext=True)
        return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)$", 1).cast("long").alias("move"), F.col("value").alias("revision"))

    def on_move(self, act, checkpoint: str):
        """Call act(before, after) for the moves that `checkpoint` hasn't seen, as one step from the last seen to the newest, and stop: what a hook does after a checkout, a merge or a push."""

        def step(batch: DataFrame, _: int) -> None:
            ends = batch.agg(F.min("move").alias("first"), F.max(F.struct("move", "revision")).alias("last")).first()
            if ends["last"]:
                before = self._text(f"{self.root}/head/{ends['first'] - 1:012d}") if ends["first"] > 1 else None
                act(before, ends["last"]["revision"])

        query = self.moves().writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def register_sql(spark: SparkSession) -> None:
    """The engine's expressions as SQL functions of this session."""
    for text in (
        "asset_key(prefix STRING, hash STRING, path STRING) RETURNS STRING RETURN concat_ws('/', prefix, 'assets', hash, path)",
        "shard_for(path STRING) RETURNS STRING RETURN CASE WHEN contains(path, '/') AND substring_index(path, '/', 1) <> '' THEN substring_index(path, '/', 1) ELSE '_root' END",
        "key_stems(key STRING) RETURNS ARRAY<STRING> RETURN array_distinct(array(key, regexp_replace(key, '[.]chunk[0-9]+$', ''), regexp_replace(key, '[.]gz$', ''), regexp_replace(regexp_replace(key, '[.]chunk[0-9]+$', ''), '[.]gz$', '')))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")

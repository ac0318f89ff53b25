"""Queries against the objects of a store: coverage, missing assets, garbage, location, chunks.

Objects have (key, size). An object belongs to a base key if it is that key, with .gz, with a chunk
number, or with both. The match runs over at most four candidates of each object, as an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import keys

#: Seconds that an upload's claim on a key lasts.
CLAIM_SECONDS = 86_400


def coverage(objects: DataFrame, bases: DataFrame) -> DataFrame:
    """key and base for each object and the base key that it belongs to."""
    candidates = objects.select("key", F.explode(keys.stems_of("key")).alias("base"))
    return candidates.join(bases.select("base").distinct(), "base").select("key", "base")


def entries_with_base(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.select("path", "hash", keys.asset_key(prefix, "hash", "path").alias("base"))


def missing(manifest: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """Entries of which no object is there; whether all chunks are is not asked."""
    found = objects.select(F.explode(keys.stems_of("key")).alias("base"))
    return entries_with_base(manifest, prefix).join(found, "base", "left_anti").select("path", "hash")


def recoverable(disk: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """Files whose present content the store has."""
    found = objects.select(F.explode(keys.stems_of("key")).alias("base"))
    return entries_with_base(disk, prefix).join(found, "base", "left_semi").select("path", "hash")


def live_claims(claims: DataFrame, now: float) -> DataFrame:
    """base and claimed_at of the latest claims that haven't expired."""
    return claims.groupBy("base").agg(F.max("claimed_at").alias("claimed_at")).where(F.col("claimed_at") >= now - CLAIM_SECONDS)


def live_set(manifest: DataFrame, claims: DataFrame, prefix: str, now: float) -> DataFrame:
    """Base keys that must stay."""
    return entries_with_base(manifest, prefix).select("base").union(live_claims(claims, now).select("base")).distinct()


def garbage(objects: DataFrame, live: DataFrame, prefix: str) -> DataFrame:
    """Asset-shaped objects that belong to no live base."""
    assets = objects.where(keys.is_asset_key(prefix, "key"))
    kept = coverage(assets, live).select("key").distinct()
    return assets.join(kept, "key", "left_anti").select("key", "size")


def confirmed_garbage(first: DataFrame, second: DataFrame) -> DataFrame:
    """What two looks at different times both call garbage."""
    return first.join(second, "key", "left_semi")


def locate(manifest: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """path, state, form (raw or gz), chunked, parts and bytes of the stored form of each entry: raw before gz, and in either the whole object before chunks.

    The state is ok, broken (chunks are what is to be read, and one is missing: nothing else is tried) or missing.
    """
    bases = entries_with_base(manifest, prefix).select("path", "base")
    parts = objects.select("key", "size", F.explode(keys.stems_of("key")).alias("base")).join(bases, "base")
    behind = F.substring(F.col("key"), F.length("base") + 1, F.lit(1 << 30))
    parts = parts.withColumns({"gz": behind.startswith(".gz"), "chunk": keys.chunk_index(behind)})
    forms = parts.groupBy("path", "gz", F.col("chunk").isNotNull().alias("chunked")).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"), F.count_distinct("chunk").alias("n")
    )
    whole = ~F.col("chunked") | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
    first = forms.groupBy("path").agg(F.min(F.struct("gz", "chunked", "parts", "bytes", whole.alias("whole"))).alias("x"))
    state = F.when(F.col("x").isNull(), "missing").when(F.col("x.whole"), "ok").otherwise("broken")
    form = F.when(F.col("x.gz"), "gz").when(~F.col("x.gz"), "raw")
    return manifest.select("path").join(first, "path", "left").select("path", state.alias("state"), form.alias("form"), "x.chunked", "x.parts", "x.bytes")


def contiguity(objects: DataFrame) -> DataFrame:
    """base, n_chunks and complete for each base that has chunks: their numbers are 0 to n-1."""
    chunks = objects.select(F.regexp_replace("key", r"[.]chunk[0-9]+\z", "").alias("base"), keys.chunk_index("key").alias("chunk")).where("chunk is not null")
    got = chunks.groupBy("base").agg(F.count_distinct("chunk").alias("n_chunks"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return got.select("base", "n_chunks", ((F.col("lo") == 0) & (F.col("hi") == F.col("n_chunks") - 1)).alias("complete"))


def complete_uploads(chunks: DataFrame) -> DataFrame:
    """manifest_key, expected, done and publish: an entry is published when all of its chunks have landed."""
    done = F.sum(F.col("landed").cast("long"))
    got = chunks.groupBy("manifest_key").agg(F.count(F.lit(1)).alias("expected"), done.alias("done"))
    return got.withColumn("publish", F.col("done") == F.col("expected"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """manifest_key and content: chunks (chunk_index, content) put together in order, in one row a file. transfer.download() writes files of any size chunk by chunk instead."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: F.hex(x["content"]))
    return chunks.groupBy("manifest_key").agg(F.unhex(F.array_join(ordered, "")).alias("content"))


def verify(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (path, content) whose digest is the entry's, and the others with both digests."""
    rows = files.withColumn("found", F.sha2("content", 256)).join(manifest.select("path", "hash"), "path")
    return rows.where("found = hash").select("path", "content"), rows.where("found <> hash").select("path", "hash", "found")


def skip_upload(files: DataFrame, objects: DataFrame) -> DataFrame:
    """key and skip: the store's etag is the MD5 of what would be sent."""
    rows = files.join(objects.select("key", "etag"), "key", "left")
    return rows.select("key", F.coalesce(F.md5("content") == F.col("etag"), F.lit(False)).alias("skip"))


def delete_victims(base: str, objects: DataFrame) -> DataFrame:
    """The keys that deleting an asset removes: all of its objects, or the base itself where none is listed."""
    own = objects.where(F.col("key").startswith(base)).select("key", F.explode(keys.stems_of("key")).alias("base")).where(F.col("base") == base).select("key")
    spark = objects.sparkSession
    return own.union(spark.createDataFrame([(base,)], "key string").join(own.limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_anti"))

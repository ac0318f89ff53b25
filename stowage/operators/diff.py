"""What differs between a manifest, another revision of it, the working copy and the store.

Relations: manifests and working copies have (path, hash), caches (path, hash, size, mtime, inode,
timestamp). Every operator is a plan: it names actions and has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import keys

#: More deletions than this, and than this share of what was checked, are held back.
BULK_COUNT, BULK_SHARE = 5, 0.5
#: A cached hash is trusted if it was taken so many seconds after the file changed.
GRANULARITY = 1.0
#: Names and endings of what editors, interpreters and file browsers leave behind.
DROPPING_NAMES, DROPPING_ENDINGS = (".DS_Store", "Thumbs.db"), (".tmp", ".swp", ".swo", ".pyc", "~")


def _beside(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """`left` with the hash that `right` has for its path, and whether it has the path at all."""
    return left.join(right.select("path", F.col("hash").alias(name), F.lit(True).alias(f"has_{name}")), "path", "left")


def status(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """path, hash, disk_hash and status: missing, up_to_date or modified."""
    state = F.when(F.col("has_disk_hash").isNull(), "missing").when(F.col("hash") == F.col("disk_hash"), "up_to_date").otherwise("modified")
    return _beside(manifest.select("path", "hash"), disk, "disk_hash").select("path", "hash", "disk_hash", state.alias("status"))


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def porcelain(states: DataFrame) -> DataFrame:
    """Rank, code and path in listing order: modified, missing, up to date."""
    rank = F.when(F.col("status") == "modified", 0).when(F.col("status") == "missing", 1).otherwise(2)
    code = F.when(rank == 0, "M").when(rank == 1, "D").otherwise(" ")
    return states.select(rank.alias("rank"), code.alias("code"), "path").orderBy("rank", "path")


def delta(wanted: DataFrame, previous: DataFrame) -> DataFrame:
    """Entries that the previous revision hasn't, or has otherwise."""
    joined = _beside(wanted.select("path", "hash"), previous, "previous_hash")
    return joined.where(~F.col("hash").eqNullSafe(F.col("previous_hash"))).select("path", "hash", "previous_hash")


def dropped(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose path is gone."""
    return previous.select("path", "hash").join(current, "path", "left_anti")


def sync_plan(changed: DataFrame, disk: DataFrame, recoverable: DataFrame, force: bool = False) -> DataFrame:
    """What to do for each changed entry: skip (there already), download, or keep (a local edit that no object has)."""
    rows = _beside(changed.select("path", "hash"), disk, "disk_hash").join(recoverable.select("path", F.lit(True).alias("safe")), "path", "left")
    action = F.when(F.col("hash") == F.col("disk_hash"), "skip").when(F.col("has_disk_hash").isNull() | F.col("safe") | F.lit(force), "download").otherwise("keep")
    return rows.select("path", "hash", action.alias("action"))


def needs_upload(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest hasn't, or has otherwise."""
    return _beside(disk.select("path", "hash"), manifest, "stored").where(~F.col("hash").eqNullSafe(F.col("stored"))).select("path", "hash")


def needs_download(manifest: DataFrame, disk: DataFrame, preserve_modified: bool = False) -> DataFrame:
    """Entries that aren't on disk as recorded, and whether to fetch or to keep what is there."""
    rows = _beside(manifest.select("path", "hash"), disk, "disk_hash").where(~F.col("hash").eqNullSafe(F.col("disk_hash")))
    keep = F.col("has_disk_hash").isNotNull() & F.lit(preserve_modified)
    return rows.select("path", "hash", F.when(keep, "keep").otherwise("download").alias("action"))


def modified_scan(manifest: DataFrame, disk: DataFrame, cached: DataFrame) -> DataFrame:
    """Each entry's state: upload, deleted (it was here once), never_materialised or unchanged."""
    rows = _beside(manifest.select("path", "hash"), disk, "disk_hash").join(cached.select("path", F.lit(True).alias("was_here")), "path", "left")
    state = (
        F.when(F.col("has_disk_hash").isNull() & F.col("was_here"), "deleted")
        .when(F.col("has_disk_hash").isNull(), "never_materialised")
        .when(F.col("hash") == F.col("disk_hash"), "unchanged")
        .otherwise("upload")
    )
    return rows.select("path", state.alias("state"))


def bulk_guard(scan: DataFrame) -> DataFrame:
    """checked, deleted, and whether so many deletions are held back."""
    deleted = F.coalesce(F.sum(F.when(F.col("state") == "deleted", 1).otherwise(0)), F.lit(0))
    counts = scan.agg(F.count(F.lit(1)).alias("checked"), deleted.cast("long").alias("deleted"))
    return counts.withColumn("held_back", (F.col("deleted") > BULK_COUNT) & (F.col("deleted") > BULK_SHARE * F.col("checked")))


def prune_plan(to_remove: DataFrame, disk: DataFrame, recoverable: DataFrame) -> DataFrame:
    """What to do with each path that is to go: skip (not there), keep (no object has it), remove."""
    rows = _beside(to_remove.select("path").distinct(), disk, "disk_hash").join(recoverable.select("path", F.lit(True).alias("safe")), "path", "left")
    action = F.when(F.col("has_disk_hash").isNull(), "skip").when(F.col("safe"), "remove").otherwise("keep")
    return rows.select("path", action.alias("action"))


def is_dropping(path: Column | str) -> Column:
    """Whether a file is what an editor, an interpreter or a file browser leaves behind, by its name alone."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.element_at(F.split(path, "/"), -1).isin(*DROPPING_NAMES)
    for ending in DROPPING_ENDINGS:
        out = out | path.endswith(ending)
    return out


def hidden(disk: DataFrame, directories: DataFrame, manifest: DataFrame, limit: int | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Files under tracked directories that the manifest doesn't know, in order. Directories meet by equality with each file's ancestors.

    With `changed` (directory), only files right in one of those: a file that is added changes its directory's time.
    """
    if changed is not None:
        folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)).otherwise("")
        disk = disk.withColumn("directory", folder).join(changed.select("directory"), "directory", "left_semi")
    files = disk.select("path").where(~is_dropping("path") & ~keys.in_internal_dir("path"))
    under = files.select("path", F.explode(keys.ancestors("path")).alias("directory")).join(directories, "directory", "left_semi").select("path").distinct()
    found = under.join(manifest, "path", "left_anti").orderBy("path")
    return found.limit(limit) if limit else found


def staged_files(staged: DataFrame) -> DataFrame:
    """Staged paths (path, status), other than deletions."""
    return staged.where("status <> 'D'").select("path")


def dual_ownership(staged: DataFrame, manifest: DataFrame) -> DataFrame:
    """Staged paths, other than deletions, that the manifest also owns."""
    return staged_files(staged).intersect(manifest.select("path"))


def to_deindex(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths that the index of version control still has though the manifest owns them, in order."""
    return index.select("path").distinct().join(manifest, "path", "left_semi").orderBy("path")


def commit_range(commits: DataFrame, base: str | None, last: str) -> DataFrame:
    """Commits (ord, sha) after `base` up to `last`, in order; from the first one without a base. None for a commit that isn't there."""
    ends = commits.agg(F.max(F.when(F.col("sha") == base, F.col("ord"))).alias("_base") if base else F.lit(None).cast("long").alias("_base"), F.max(F.when(F.col("sha") == last, F.col("ord"))).alias("_last"))
    begins = F.lit(True) if base is None else F.col("ord") > F.col("_base")
    return commits.join(F.broadcast(ends)).where(begins & (F.col("ord") <= F.col("_last"))).select("ord", "sha").orderBy("ord")


def distinct_pairs(*revisions: DataFrame) -> DataFrame:
    """Each (path, hash) of some revisions once."""
    pairs = [r.select("path", "hash") for r in revisions]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.union(more)
    return out.distinct()


def racy(timestamp: Column, mtime: Column) -> Column:
    """Whether a hash was taken so soon after a change that another could hide behind it."""
    return F.coalesce(timestamp - mtime < GRANULARITY, F.lit(True))


def cached_hash(disk: DataFrame, cache: DataFrame, trust_racy: bool = False) -> DataFrame:
    """path, hash and hit: from the cache where size, mtime and inode agree and the entry isn't racy, else computed from content."""
    c = cache.select("path", F.col("hash").alias("_hash"), F.struct("size", "mtime", "inode").alias("_was"), F.col("timestamp").alias("_at"), F.col("mtime").alias("_mtime"))
    hit = F.coalesce(F.struct("size", "mtime", "inode").eqNullSafe(F.col("_was")) & (F.lit(trust_racy) | ~racy(F.col("_at"), F.col("_mtime"))), F.lit(False))
    rows = disk.join(c, "path", "left").withColumn("hit", hit)
    return rows.select("path", F.when(F.col("hit"), F.col("_hash")).otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("hash"), "hit")


def cache_counters(hashed: DataFrame) -> DataFrame:
    return hashed.agg(F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"), F.coalesce(F.sum((~F.col("hit")).cast("long")), F.lit(0)).alias("misses"))


def config_mismatch(here: DataFrame, there: DataFrame) -> DataFrame:
    """Settings (key, value) that both have, with different values."""
    return here.join(there.select("key", F.col("value").alias("other")), "key").where("value <> other")


def changed_pairs(tips: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct (path, hash) of some revisions that the base hasn't."""
    return tips.select("path", "hash").distinct().join(base, ["path", "hash"], "left_anti")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first by `order`."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def changed_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and changed: whether a file's stat (size, mtime, inode) differs between two looks, or the file is gone."""
    stat = lambda df, name: df.select("path", F.struct("size", "mtime", "inode").alias(name))
    return stat(before, "_was").join(stat(after, "_is"), "path", "left").select("path", (~F.col("_was").eqNullSafe(F.col("_is"))).alias("changed"))


def recent(rows: DataFrame, since: float) -> DataFrame:
    """Directories, or files, that changed after a time: what an incremental scan has to look at."""
    return rows.where(F.col("mtime") > since)

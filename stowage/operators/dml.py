"""Changes to manifests, caches and ignore blocks as plans: each gives the relation after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import content, globs, keys

#: Lines are numbered in ranges of 2^RANGE_BITS of their places.
RANGE_BITS = 16


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def forget(rows: DataFrame, gone: DataFrame | None, key: str = "path") -> DataFrame:
    """Without the given keys; without any if there are none given."""
    return rows.limit(0) if gone is None else rows.join(gone, key, "left_anti")


def remove_matching(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries that remain after removal by a pattern whose "*" crosses directories."""
    return globs.select(entries, pattern, "fnmatch", inverse=True)


def record_hashes(cache: DataFrame, hashes: DataFrame, stats: DataFrame) -> DataFrame:
    """The cache with new hashes (path, hash) and the present stat of their files; files that are gone are left out."""
    return upsert(cache, hashes.join(stats, "path").select(*cache.columns))


def evict_stale(cache: DataFrame, disk: DataFrame, now: float, max_age_days: float = 30) -> DataFrame:
    """Cache rows whose file is there and that are young enough."""
    return cache.join(disk, "path", "left_semi").where(F.lit(now) - F.col("timestamp") <= max_age_days * 86_400)


def upgrade_ignores(entries: DataFrame, added: DataFrame) -> DataFrame:
    """Ignore entries (entry) without those below a newly added directory (an entry that ends in a slash). Directories meet by equality with ancestors."""
    dirs = added.where(F.col("entry").endswith("/")).select(F.expr("rtrim('/', entry)").alias("_dir"))
    plain = F.expr("rtrim('/', entry)")
    below = entries.select("entry", F.explode(keys.ancestors(plain)).alias("_dir")).join(dirs, "_dir", "left_semi").select("entry")
    return entries.join(below, "entry", "left_anti").union(added.select("entry")).distinct()


def ordinals(rows: DataFrame) -> DataFrame:
    """`rows` (part, ord, ...: whole numbers) with `ord` their places from 1, in order of part and ord.

    Rows are counted by ranges of ord, and numbered within each: only one row a range is ever sorted in one task.
    """
    ranged = rows.withColumn("_range", F.shiftright("ord", RANGE_BITS))
    counts = ranged.groupBy("part", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("part", "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("part", "_range").orderBy("ord"))
    numbered = ranged.withColumn("_nth", nth).join(counts, ["part", "_range"]).withColumn("ord", F.col("_before") + F.col("_nth"))
    return numbered.select(*[c for c in rows.columns if c != "part"])


def add_lines(block: DataFrame, lines: DataFrame) -> DataFrame:
    """A block (ord, line) with lines at its end, each line once, at its first place."""
    rows = block.select(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), "line").union(lines.select(F.lit(1), F.col("ord").cast("long"), F.col("line")))
    first = rows.groupBy("line").agg(F.min(F.struct("part", "ord")).alias("at"))
    return ordinals(first.select("at.part", "at.ord", "line"))


def remove_lines(block: DataFrame, lines: DataFrame) -> DataFrame:
    """A block (ord, line) without the given lines; what stays keeps its order."""
    kept = block.join(lines.select("line"), "line", "left_anti")
    return ordinals(kept.select(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), "line"))


def write_block(sections: DataFrame, start: str, end: str) -> DataFrame:
    """ord and line of the file that has these sections (section, ord, line): the block between its markers, behind a blank line if what comes before it ends otherwise; no markers around an empty block."""
    part = F.when(F.col("section") == "before", 0).when(F.col("section") == "block", 3).otherwise(5)
    rows = sections.select(part.alias("part"), F.col("ord").cast("long").alias("ord"), "line")
    ends = rows.agg(F.max(F.when(F.col("part") == 0, F.struct("ord", "line"))).alias("last"), F.max(F.col("part") == 3).alias("some"))
    marks = ends.where("some").select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("ord"), x.alias("line")) for p, x in ((1, F.when(F.col("last.line").rlike(r"\S"), "")), (2, F.lit(start)), (4, F.lit(end)))])).alias("m")).select("m.*")
    return ordinals(rows.unionByName(marks.where("line is not null")))


def emptied_parents(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Directories that held deleted files and hold nothing now."""
    gone = deleted.select(F.explode(keys.ancestors("path")).alias("directory")).distinct()
    held = remaining.select(F.explode(keys.ancestors("path")).alias("directory")).distinct()
    return gone.join(held, "directory", "left_anti")


def lfs_patterns(lines: DataFrame) -> DataFrame:
    """Patterns of an attributes file (value) whose attributes have filter=lfs."""
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 2) & F.array_contains(F.slice("p", 2, 1 << 20), "filter=lfs"))
    return rows.select(F.col("p")[0].alias("pattern"))


def listing(entries: DataFrame, cwd: str = "") -> DataFrame:
    """Entries in order, as shown in `cwd`."""
    return entries.orderBy("path").withColumn("shown", keys.display("path", cwd))


def first_and_more(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n rows, with how many more there are."""
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    return rows.orderBy(order).limit(n).join(F.broadcast(total)).withColumn("more", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def split_block(lines: DataFrame, start: str, end: str) -> DataFrame:
    """ord, line and section (before, block, after) of a file with a marked block; the markers are in no section, and blank lines in none if they are in the block.

    A block without an end is none: its start marker goes, and what follows is after.
    """
    marks = lines.agg(F.min(F.when(F.col("line") == start, F.col("ord"))).alias("_start"))
    begun = lines.join(F.broadcast(marks))
    ends = begun.agg(F.min(F.when((F.col("line") == end) & (F.col("ord") > F.col("_start")), F.col("ord"))).alias("_end"))
    rows = begun.join(F.broadcast(ends))
    section = F.when(F.col("_start").isNull() | (F.col("ord") < F.col("_start")), "before").when(F.col("ord") < F.col("_end"), "block").otherwise("after")
    marker = F.coalesce(F.col("ord") == F.col("_start"), F.lit(False)) | F.coalesce(F.col("ord") == F.col("_end"), F.lit(False))
    return rows.where(~marker).select("ord", "line", section.alias("section")).where("section <> 'block' or line rlike '\\\\S'")


def claim(claims: DataFrame, bases: DataFrame, now: float) -> DataFrame:
    """Claims (base, claimed_at) after these bases are claimed, or claimed again."""
    return upsert(claims.select("base", "claimed_at"), bases.select("base", F.lit(now).alias("claimed_at")).distinct(), "base")


def release(claims: DataFrame, bases: DataFrame, now: float, seconds: float) -> DataFrame:
    """Claims after these bases are released; what has expired goes too."""
    return claims.join(bases, "base", "left_anti").where(F.col("claimed_at") >= now - seconds).select("base", "claimed_at")


def publish(manifest: DataFrame, uploads: DataFrame) -> DataFrame:
    """The manifest after uploads (path, hash, landed: a row for each chunk): an entry changes when all of its chunks have landed."""
    done = uploads.groupBy("path", "hash").agg(F.min("landed").alias("all_landed")).where("all_landed").select("path", "hash")
    return upsert(manifest.select("path", "hash"), done)


def ignore_pattern(spec: Column, is_dir: Column, is_file: Column) -> Column:
    """The ignore entry for what a user tracks: a directory with a slash at its end, a file escaped, a pattern exactly as it is."""
    plain = F.regexp_replace(spec, "/+$", "")
    globbed = spec.rlike(r"[*?\[]")
    return F.when(is_dir, F.concat(F.lit("/"), keys.escape_ignore(plain), F.lit("/"))).when(is_file | ~globbed, F.concat(F.lit("/"), keys.escape_ignore(plain))).otherwise(F.concat(F.lit("/"), spec))


def lfs_files(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """The files (path, ...) that patterns of an attributes file (value: its lines) name. A pattern without a slash holds at any depth.

    Patterns are a handful of lines, and a condition each.
    """
    hit = F.lit(False)
    for (pattern,) in lfs_patterns(attributes).distinct().orderBy("pattern").collect():
        hit = hit | globs.matches("path", pattern if "/" in pattern else f"**/{pattern}")
    return files.where(hit)


def lfs_import(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """path and pointer of the files (path, content) that an attributes file names: a pointer must be replaced by its content before it is tracked."""
    return lfs_files(files, attributes).select("path", content.is_lfs_pointer(F.col("content")).alias("pointer"))


def lfs_bytes(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """The bytes of the files (path, size) that an attributes file names."""
    return lfs_files(files, attributes).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))

"""Every operator on asset collections as a query over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import content, globs, keys
from stowage.operators import diff, dml, merge, metrics, profile, store
from stowage.plans.relations import NOW, PREFIX, Relations, with_relations

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Sparse profile of the queries: two directories, one of them nested.
CONE = ["src1", "src3/fr"]


def _query(name: str, sql: str | None = None, *relations: str, **more: str):
    """Register a function of Relations as a query; `sql` says the same over the named relations."""

    def add(build: Callable[[Relations], DataFrame]):
        _QUERIES[name] = lambda spark, root: build(Relations(spark, root))
        if sql:
            _ORACLES[name] = with_relations(sql, *relations, **more) if relations or more else sql
        return build

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Joins ------------------------------------------------------------------------------------------

_STATUS = "SELECT c.path, c.hash, d.hash AS disk_hash, CASE WHEN d.path IS NULL THEN 'missing' WHEN d.hash = c.hash THEN 'up_to_date' ELSE 'modified' END AS status FROM cur c LEFT JOIN disk d USING (path)"
_RECOVERABLE = "SELECT path, hash FROM disk WHERE 'p/assets/' || hash || '/' || path IN (SELECT base FROM stems)"
_DELTA = "SELECT c.path, c.hash, p.hash AS previous_hash FROM cur c LEFT JOIN prev p USING (path) WHERE c.hash IS DISTINCT FROM p.hash"


@_query("o_j1_status", _STATUS, "cur", "disk")
def _(r):
    return diff.status(r.cur, r.disk)


@_query("o_j2_delta", _DELTA, "cur", "prev")
def _(r):
    return diff.delta(r.cur, r.prev)


@_query("o_j3_dropped", "SELECT path, hash FROM prev WHERE path NOT IN (SELECT path FROM cur)", "prev", "cur")
def _(r):
    return diff.dropped(r.prev, r.cur)


@_query(
    "o_j4_sync_plan",
    "SELECT c.path, c.hash, CASE WHEN c.hash = d.hash THEN 'skip' WHEN d.path IS NULL OR r.path IS NOT NULL THEN 'download' ELSE 'keep' END AS action FROM changed c LEFT JOIN disk d USING (path) LEFT JOIN recoverable r USING (path)",
    "cur", "prev", "disk", "stems", changed=_DELTA, recoverable=_RECOVERABLE,
)
def _(r):
    return diff.sync_plan(diff.delta(r.cur, r.prev), r.disk, store.recoverable(r.disk, r.store, PREFIX))


@_query("o_j5_recoverable", _RECOVERABLE, "disk", "stems")
def _(r):
    return store.recoverable(r.disk, r.store, PREFIX)


@_query("o_j6_coverage", "SELECT s.key, s.base FROM stems s JOIN (SELECT DISTINCT 'p/assets/' || hash || '/' || path AS base FROM cur) USING (base)", "stems", "cur")
def _(r):
    return store.coverage(r.store, store.entries_with_base(r.cur, PREFIX))


@_query("o_j7_missing", "SELECT path, hash FROM cur WHERE 'p/assets/' || hash || '/' || path NOT IN (SELECT base FROM stems)", "cur", "stems")
def _(r):
    return store.missing(r.cur, r.store, PREFIX)


_LIVE_CLAIMS = f"SELECT base, max(claimed_at) AS claimed_at FROM claims GROUP BY base HAVING max(claimed_at) >= {NOW} - 86400"
_LIVE = "SELECT 'p/assets/' || hash || '/' || path AS base FROM cur UNION SELECT base FROM live_claims"


@_query(
    "o_j8_garbage",
    "SELECT key, size FROM store WHERE regexp_matches(key, '^p/assets/[^/]+/.+') AND key NOT IN (SELECT key FROM stems JOIN live USING (base))",
    "cur", "stems", "claims", live_claims=_LIVE_CLAIMS, live=_LIVE,
)
def _(r):
    return store.garbage(r.store, store.live_set(r.cur, r.claims, PREFIX, NOW), PREFIX)


@_query("o_j9_needs_upload", "SELECT d.path, d.hash FROM disk d LEFT JOIN cur c USING (path) WHERE d.hash IS DISTINCT FROM c.hash", "disk", "cur")
def _(r):
    return diff.needs_upload(r.disk, r.cur)


@_query(
    "o_j10_skip_upload",
    "SELECT f.path AS key, coalesce(md5(f.content) = o.etag, false) AS skip FROM files f LEFT JOIN (SELECT path AS key, md5(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS etag FROM docs WHERE doc_id % 3 <> 0) o ON f.path = o.key",
    "files",
)
def _(r):
    etag = F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.skip_upload(r.files.withColumnRenamed("path", "key"), r.docs.where("doc_id % 3 <> 0").select(F.col("path").alias("key"), etag.alias("etag")))


@_query(
    "o_j11_needs_download",
    "SELECT c.path, c.hash, CASE WHEN d.path IS NOT NULL THEN 'keep' ELSE 'download' END AS action FROM cur c LEFT JOIN disk d USING (path) WHERE c.hash IS DISTINCT FROM d.hash",
    "cur", "disk",
)
def _(r):
    return diff.needs_download(r.cur, r.disk, preserve_modified=True)


_SCAN = "SELECT c.path, CASE WHEN d.path IS NULL AND k.path IS NOT NULL THEN 'deleted' WHEN d.path IS NULL THEN 'never_materialised' WHEN d.hash = c.hash THEN 'unchanged' ELSE 'upload' END AS state FROM cur c LEFT JOIN disk d USING (path) LEFT JOIN cache k USING (path)"


@_query("o_j12_modified_scan", _SCAN, "cur", "disk", "cache")
def _(r):
    return diff.modified_scan(r.cur, r.disk, r.cache)


def _map(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("key"), F.when(F.col("doc_id") % 23 != 0, F.col("hash")).alias("value"))


_SIDE = "SELECT path AS key, CASE WHEN doc_id % 23 <> 0 THEN hash END AS value, true AS there FROM "
_MERGE = """SELECT key, CASE WHEN NOT mine AND other THEN tv ELSE ov END AS value, mine AND other AND (ot IS DISTINCT FROM tt OR ov IS DISTINCT FROM tv) AS conflict,
    CASE WHEN NOT mine AND other THEN tt ELSE ot END AS there FROM (SELECT *, ot IS DISTINCT FROM bt OR ov IS DISTINCT FROM bv AS mine, tt IS DISTINCT FROM bt OR tv IS DISTINCT FROM bv AS other
    FROM (SELECT key, b.value AS bv, b.there AS bt, o.value AS ov, o.there AS ot, t.value AS tv, t.there AS tt FROM b FULL JOIN o USING (key) FULL JOIN t USING (key)))"""


@_query("o_j13_merge", "SELECT key, value, conflict FROM merged WHERE there OR conflict", "prev", "cur", "theirs", b=_SIDE + "prev", o=_SIDE + "cur", t=_SIDE + "theirs", merged=_MERGE)
def _(r):
    return merge.merge_maps(_map(r.prev), _map(r.cur), _map(r.theirs))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("/"), "path").alias("line"), F.col("doc_id").alias("ord"))


@_query(
    "o_j14_merge_ordered",
    """SELECT line, row_number() OVER (ORDER BY part, ord) AS ord FROM (SELECT line, 0 AS part, ord FROM b WHERE line IN (SELECT line FROM o) AND line IN (SELECT line FROM t)
    UNION ALL SELECT line, 1, ord FROM o WHERE line NOT IN (SELECT line FROM b)
    UNION ALL SELECT line, 2, ord FROM t WHERE line NOT IN (SELECT line FROM b) AND line NOT IN (SELECT line FROM o))""",
    "prev", "cur", "theirs", b="SELECT '/' || path AS line, doc_id AS ord FROM prev", o="SELECT '/' || path AS line, doc_id % 10 * 1000000000 + doc_id AS ord FROM cur", t="SELECT '/' || path AS line, 1000000000 - doc_id AS ord FROM theirs",
)
def _(r):
    """Each side has an order of its own."""
    ours = _lines(r.cur).withColumn("ord", F.col("ord") % 10 * 1_000_000_000 + F.col("ord"))
    theirs = _lines(r.theirs).withColumn("ord", 1_000_000_000 - F.col("ord"))
    return dml.ordinals(merge.merge_lists(_lines(r.prev), ours, theirs))


def _documents(r: Relations, df: DataFrame, limit: str) -> DataFrame:
    settings = r.spark.createDataFrame([("bucket", "assets"), ("limit", limit)], "key string, value string")
    return df.select(F.lit("files").alias("kind"), F.col("path").alias("key"), F.col("hash").alias("value")).union(settings.select(F.lit("meta"), "key", "value"))


_DOCUMENT = "SELECT 'files/' || path AS key, hash AS value, true AS there FROM {} UNION ALL SELECT * FROM (VALUES ('meta/bucket', 'assets', true), ('meta/limit', '{}', true))"


@_query(
    "o_j15_merge_manifests",
    "SELECT split_part(key, '/', 1) AS kind, substr(key, strpos(key, '/') + 1) AS key, value, conflict FROM merged WHERE there OR conflict",
    "prev", "cur", "theirs", b=_DOCUMENT.format("prev", 1), o=_DOCUMENT.format("cur", 2), t=_DOCUMENT.format("theirs", 3), merged=_MERGE,
)
def _(r):
    return merge.merge_manifests(_documents(r, r.prev, "1"), _documents(r, r.cur, "2"), _documents(r, r.theirs, "3"))


#: Fixed endings that turn a file of the working copy into something beside it, by doc_id.
_BESIDE = (".pyc", "~", ".tmp", ".swp", ".swo", "/.DS_Store", "/Thumbs.db", "/__pycache__/m.txt", "/.git/config", ".lock")
_EVERYTHING = "SELECT path FROM disk UNION ALL SELECT path || [" + ", ".join(f"'{x}'" for x in _BESIDE) + f"][doc_id % {len(_BESIDE)} + 1] FROM disk WHERE doc_id % 3 = 1"
_DROPPING = "(regexp_matches(path, '([.]tmp|[.]swp|[.]swo|[.]pyc|~)$') OR split_part(path, '/', -1) IN ('.DS_Store', 'Thumbs.db'))"


def _everything(r: Relations) -> DataFrame:
    """The working copy with what editors and others leave beside its files."""
    ending = F.get(F.array(*map(F.lit, _BESIDE)), (F.col("doc_id") % len(_BESIDE)).cast("int"))
    return r.disk.select("path").union(r.disk.where("doc_id % 3 = 1").select(F.concat("path", ending)))


@_query(
    "o_j16_hidden",
    f"SELECT path FROM everything WHERE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) IN (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM cur WHERE doc_id % 3 = 0) AND path NOT IN (SELECT path FROM cur) AND NOT {_DROPPING} AND NOT contains(path, '/.git/')",
    "disk", "cur", everything=_EVERYTHING,
)
def _(r):
    directories = r.cur.where("doc_id % 3 = 0").select(F.substring_index("path", "/", 2).alias("directory")).distinct()
    return diff.hidden(_everything(r), directories, r.cur)


@_query("o_j17_dual_ownership", "SELECT path FROM docs WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0 AND path IN (SELECT path FROM cur)", "docs", "cur")
def _(r):
    staged = r.docs.where("doc_id % 4 = 0").select("path", F.when(F.col("doc_id") % 12 == 0, "D").otherwise("M").alias("status"))
    return diff.dual_ownership(staged, r.cur)


_PARTS = "SELECT e.path, s.size, starts_with(substr(s.key, length(s.base) + 1), '.gz') AS gz, CAST(nullif(regexp_extract(s.key, '[.]chunk([0-9]+)$', 1), '') AS INTEGER) AS chunk FROM stems s JOIN (SELECT path, 'p/assets/' || hash || '/' || path AS base FROM cur) e USING (base)"
_FORMS = "SELECT path, gz, chunk IS NOT NULL AS chunked, count(*) AS parts, CAST(sum(size) AS BIGINT) AS bytes, min(chunk) AS lo, max(chunk) AS hi, count(DISTINCT chunk) AS n FROM parts GROUP BY 1, 2, 3"


@_query(
    "o_j18_locate",
    """SELECT c.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN chunked AND NOT (lo = 0 AND hi = n - 1) THEN 'broken' ELSE 'ok' END AS state, CASE WHEN gz THEN 'gz' WHEN NOT gz THEN 'raw' END AS form, chunked, parts, bytes
    FROM cur c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gz, chunked) AS r FROM forms) f ON c.path = f.path AND r = 1""",
    "cur", "stems", parts=_PARTS, forms=_FORMS,
)
def _(r):
    return store.locate(r.cur, r.store, PREFIX)


_CACHED = "SELECT f.path, coalesce(f.size = k.size AND f.mtime = k.mtime AND f.inode = k.inode AND NOT k.timestamp - k.mtime < 1.0, false) AS hit, k.hash AS cached, f.content FROM files f LEFT JOIN cache k USING (path)"


@_query("o_j19_cached_hash", "SELECT path, CASE WHEN hit THEN cached ELSE sha256(content) END AS hash, hit FROM looked", "files", "cache", looked=_CACHED)
def _(r):
    return diff.cached_hash(r.files, r.cache)


@_query(
    "o_j20_config_mismatch",
    "SELECT h.key, h.value, t.value AS other FROM (SELECT path AS key, hash AS value FROM cur) h JOIN (SELECT path AS key, hash AS value FROM prev) t USING (key) WHERE h.value <> t.value",
    "cur", "prev",
)
def _(r):
    pair = lambda df: df.select(F.col("path").alias("key"), F.col("hash").alias("value"))
    return diff.config_mismatch(pair(r.cur), pair(r.prev))


_IN_CONE = "(starts_with({0}, 'src1/') OR starts_with({0}, 'src3/fr/') OR NOT contains({0}, '/') OR ({0} LIKE 'src3/%' AND {0} NOT LIKE 'src3/%/%'))".format
_TO_REMOVE = f"SELECT path FROM prev WHERE path NOT IN (SELECT path FROM cur) UNION SELECT path FROM cur WHERE NOT {_IN_CONE('path')}"


@_query("o_j21_out_of_profile", _TO_REMOVE, "prev", "cur")
def _(r):
    return profile.to_remove(r.prev, r.cur, CONE)


@_query(
    "o_j22_prune_plan",
    "SELECT x.path, CASE WHEN d.path IS NULL THEN 'skip' WHEN r.path IS NOT NULL THEN 'remove' ELSE 'keep' END AS action FROM gone x LEFT JOIN disk d USING (path) LEFT JOIN recoverable r USING (path)",
    "prev", "cur", "disk", "stems", gone=_TO_REMOVE, recoverable=_RECOVERABLE,
)
def _(r):
    return diff.prune_plan(profile.to_remove(r.prev, r.cur, CONE), r.disk, store.recoverable(r.disk, r.store, PREFIX))


# Aggregations -------------------------------------------------------------------------------------


@_query(
    "o_a1_contiguity",
    "SELECT base, count(DISTINCT chunk) AS n_chunks, min(chunk) = 0 AND max(chunk) = count(DISTINCT chunk) - 1 AS complete FROM (SELECT regexp_replace(key, '[.]chunk[0-9]+$', '') AS base, CAST(nullif(regexp_extract(key, '[.]chunk([0-9]+)$', 1), '') AS INTEGER) AS chunk FROM store) WHERE chunk IS NOT NULL GROUP BY base",
    "store",
)
def _(r):
    return store.contiguity(r.store)


_UPLOADS = "SELECT manifest_key, count(*) AS expected, CAST(sum(CASE WHEN length(text) % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS done FROM chunks GROUP BY manifest_key"


def _landed(r: Relations) -> DataFrame:
    return r.chunks.withColumn("landed", F.length(F.col("content").cast("string")) % 7 != 0)


@_query("o_a2_upload_complete", "SELECT *, done = expected AS publish FROM uploads", "chunks", uploads=_UPLOADS)
def _(r):
    return store.complete_uploads(_landed(r))


@_query("o_a3_reassemble", "SELECT manifest_key, sha256(string_agg(text, '' ORDER BY chunk_index)) AS hash FROM chunks GROUP BY manifest_key", "chunks")
def _(r):
    return store.reassemble(r.chunks).select("manifest_key", F.sha2("content", 256).alias("hash"))


@_query("o_a4_download_failures", "SELECT count(*) AS files, CAST(sum(expected - done) AS BIGINT) AS failed_chunks, count(*) FILTER (WHERE done < expected) AS incomplete FROM uploads", "chunks", uploads=_UPLOADS)
def _(r):
    got = store.complete_uploads(_landed(r))
    return got.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("expected") - F.col("done")).alias("failed_chunks"), F.count(F.when(~F.col("publish"), 1)).alias("incomplete"))


@_query(
    "o_a5_bulk_guard",
    "SELECT count(*) AS checked, count(*) FILTER (WHERE state = 'deleted') AS deleted, count(*) FILTER (WHERE state = 'deleted') > 5 AND count(*) FILTER (WHERE state = 'deleted') > 0.5 * count(*) AS held_back FROM scan",
    "cur", "disk", "cache", scan=_SCAN,
)
def _(r):
    return diff.bulk_guard(diff.modified_scan(r.cur, r.disk, r.cache))


@_query("o_a6_status_counts", "SELECT status, count(*) AS n FROM states GROUP BY status", "cur", "disk", states=_STATUS)
def _(r):
    return diff.status_counts(diff.status(r.cur, r.disk))


@_query("o_a7_shard_sizes", "SELECT split_part(path, '/', 1) AS shard, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS chars FROM cur GROUP BY 1", "cur")
def _(r):
    return r.cur.groupBy(keys.shard_for("path").alias("shard")).agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("chars"))


@_query("o_a8_entry_count", "SELECT count(*) AS entries FROM cur", "cur")
def _(r):
    return r.cur.agg(F.count(F.lit(1)).alias("entries"))


@_query("o_a9_transfer_totals", "SELECT count(*) AS chunks, count(DISTINCT manifest_key) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM chunks", "chunks")
def _(r):
    return r.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("manifest_key").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@_query("o_a11_located_sizes", "SELECT path, CAST(sum(size) AS BIGINT) AS bytes FROM parts GROUP BY path", "cur", "stems", parts=_PARTS)
def _(r):
    bases = store.entries_with_base(r.cur, PREFIX)
    owned = store.coverage(r.store, bases).join(r.store, "key").join(bases, "base")
    return owned.groupBy("path").agg(F.sum("size").alias("bytes"))


@_query("o_a12_durations", "SELECT event_type AS stage, count(value) AS tasks, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def _(r):
    tasks = r.table("events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration"))
    return metrics.durations(tasks).withColumn("mean", F.round("mean", 6))


@_query("o_a13_stage_spans", "SELECT stage, max(ts) - min(ts) AS micros FROM timeline GROUP BY stage", "timeline")
def _(r):
    return r.timeline.groupBy("stage").agg((F.max("ts") - F.min("ts")).alias("micros"))


@_query("o_a14_cache_counters", "SELECT CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS misses FROM looked", "files", "cache", looked=_CACHED)
def _(r):
    return diff.cache_counters(diff.cached_hash(r.files, r.cache))


@_query(
    "o_a15_doctor",
    "SELECT level, count(*) AS n FROM (SELECT 'failure' AS level FROM cur WHERE 'p/assets/' || hash || '/' || path NOT IN (SELECT base FROM stems) UNION ALL SELECT 'warning' FROM states WHERE status = 'modified') GROUP BY level",
    "cur", "disk", "stems", states=_STATUS,
)
def _(r):
    lost = store.missing(r.cur, r.store, PREFIX).select(F.lit("failure").alias("level"))
    edited = diff.status(r.cur, r.disk).where("status = 'modified'").select(F.lit("warning").alias("level"))
    return lost.union(edited).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@_query("o_a17_first_of_each", "SELECT hash, min(doc_id) AS doc_id FROM cur GROUP BY hash", "cur")
def _(r):
    return diff.first_of_each(r.cur.select("hash", "doc_id"), "hash", "doc_id")


# Timelines ------------------------------------------------------------------------------------------

_WORKERS = "SELECT stage, ts, seq, CAST(sum(delta) OVER (PARTITION BY stage ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS workers FROM timeline"
_AREAS = "SELECT stage, CAST(coalesce(sum(workers * (next - ts)), 0) AS BIGINT) AS area, max(ts) - min(ts) AS span FROM (SELECT *, lead(ts) OVER (PARTITION BY stage ORDER BY ts, seq) AS next FROM workers) GROUP BY stage"


@_query("o_n1_parallelism", "SELECT *, round(CASE WHEN span > 0 THEN area / span ELSE 0 END, 6) AS average FROM areas", "timeline", workers=_WORKERS, areas=_AREAS)
def _(r):
    return metrics.average_parallelism(metrics.parallelism(metrics.active_workers(r.timeline))).withColumn("average", F.round("average", 6))


@_query("o_n2_active_workers", _WORKERS, "timeline")
def _(r):
    return metrics.active_workers(r.timeline)


@_query(
    "o_n3_utilisation",
    "SELECT stage, round(CASE WHEN max_workers > 0 AND span > 0 THEN area / span / max_workers ELSE 0 END, 6) AS utilisation FROM areas JOIN (SELECT stage, max(workers) AS max_workers FROM workers GROUP BY stage) USING (stage)",
    "timeline", workers=_WORKERS, areas=_AREAS,
)
def _(r):
    active = metrics.active_workers(r.timeline)
    peak = metrics.peak_workers(active).withColumnRenamed("peak", "max_workers")
    return metrics.utilisation(metrics.parallelism(active), peak).select("stage", F.round("utilisation", 6).alias("utilisation"))


@_query("o_n4_ordinals", "SELECT manifest_key, chunk_index, CAST(row_number() OVER (PARTITION BY manifest_key ORDER BY chunk_index) AS INTEGER) AS nth FROM chunks", "chunks")
def _(r):
    return r.chunks.select("manifest_key", "chunk_index", F.row_number().over(Window.partitionBy("manifest_key").orderBy("chunk_index")).alias("nth"))


# Sorts and limits -------------------------------------------------------------------------------------


@_query("o_t1_ls", "SELECT path, hash, CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE path END AS shown FROM cur ORDER BY path", "cur")
def _(r):
    return dml.listing(r.cur.select("path", "hash"), "src1")


@_query("o_t2_porcelain", "SELECT CASE status WHEN 'modified' THEN 0 WHEN 'missing' THEN 1 ELSE 2 END AS rank, CASE status WHEN 'modified' THEN 'M' WHEN 'missing' THEN 'D' ELSE ' ' END AS code, path FROM states", "cur", "disk", states=_STATUS)
def _(r):
    return diff.porcelain(diff.status(r.cur, r.disk))


@_query("o_t3_topk", "SELECT path, greatest(count(*) OVER () - 10, 0) AS more FROM missing ORDER BY path LIMIT 10", "cur", "stems", missing="SELECT path FROM cur WHERE 'p/assets/' || hash || '/' || path NOT IN (SELECT base FROM stems)")
def _(r):
    return dml.first_and_more(store.missing(r.cur, r.store, PREFIX).select("path"), "path")


# Sets ---------------------------------------------------------------------------------------------------


@_query("o_u1_live_set", _LIVE, "cur", "claims", live_claims=_LIVE_CLAIMS)
def _(r):
    return store.live_set(r.cur, r.claims, PREFIX, NOW)


@_query("o_u2_verify_pairs", "SELECT path, hash FROM (SELECT path, hash FROM cur UNION SELECT path, hash FROM theirs) EXCEPT SELECT path, hash FROM prev", "cur", "theirs", "prev")
def _(r):
    tips = r.cur.select("path", "hash").union(r.theirs.select("path", "hash"))
    return diff.changed_pairs(tips, r.prev)


@_query("o_u3_profile_partition", f"SELECT path, {_IN_CONE('path')} AS inside FROM cur", "cur")
def _(r):
    return r.cur.select("path", profile.covers(CONE).alias("inside"))


@_query("o_u4_intersect", "SELECT path FROM disk INTERSECT SELECT path FROM cur", "disk", "cur")
def _(r):
    return r.disk.select("path").intersect(r.cur.select("path"))


@_query("o_u5_shard_intersect", "SELECT DISTINCT split_part(path, '/', 1) AS shard FROM cur WHERE split_part(path, '/', 1) IN ('src1', 'src3', '_root')", "cur")
def _(r):
    return r.cur.select(keys.shard_for("path").alias("shard")).where(F.col("shard").isin(profile.reachable_shards(CONE))).distinct()


# Paths and predicates -------------------------------------------------------------------------------------

_URL_PATH = "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"


def _url_paths(r: Relations) -> DataFrame:
    return r.table("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@_query("o_p1_normalise", "SELECT path AS key FROM docs", "docs")
def _(r):
    return r.docs.select(keys.normalise(F.concat(F.lit("./x/../"), "source", F.lit("//"), "lang", F.lit("/./"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"))


@_query("o_p3_valid_key", "SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT ends_with(path, '/') AND NOT starts_with(path, '..') AND NOT contains(path, '/..') AND NOT contains(path, chr(92)) AS valid FROM paths", paths=_URL_PATH)
def _(r):
    return _url_paths(r).select("page_id", keys.is_valid_key("path").alias("valid"))


@_query("o_p4_from_input", "SELECT doc_id, CASE WHEN starts_with(path, 'src1/') THEN path ELSE 'src1/' || path END AS key FROM docs", "docs")
def _(r):
    return r.docs.select("doc_id", keys.from_input("path", "src1").alias("key"))


@_query("o_p5_glob", "SELECT path FROM cur WHERE regexp_full_match(path, 'src[13]/[^/]*/[^/]*1[.]txt')", "cur")
def _(r):
    return r.cur.select("path").where(globs.matches("path", "src[13]/*/*1.txt"))


@_query("o_p6_glob_recursive", "SELECT path FROM cur WHERE regexp_full_match(path, 'src1/(.*/)?[^/]*41[.]txt')", "cur")
def _(r):
    return r.cur.select("path").where(globs.matches("path", "src1/**/*41.txt"))


@_query("o_p7_select", "SELECT path FROM cur WHERE starts_with(path, 'src3/fr/')", "cur")
def _(r):
    return globs.select(r.cur.select("path"), "src3/fr")


@_query("o_p8_internal", "SELECT page_id, list_has_any(string_split(path, '/'), ['.git', '.stowage']) OR ends_with(path, '.lock') AS internal FROM paths", paths=_URL_PATH)
def _(r):
    return _url_paths(r).select("page_id", keys.is_internal("path").alias("internal"))


@_query("o_p9_asset_shape", "SELECT key, regexp_matches(key, '^p/assets/[^/]+/.+') AS asset FROM store", "store")
def _(r):
    return r.store.select("key", keys.is_asset_key(PREFIX, "key").alias("asset"))


@_query("o_p10_asset_key", "SELECT path, 'p/assets/' || hash || '/' || path AS base FROM cur", "cur")
def _(r):
    return store.entries_with_base(r.cur, PREFIX).select("path", "base")


@_query("o_p11_shard", "SELECT page_id, CASE WHEN contains(path, '/') AND split_part(path, '/', 1) <> '' THEN split_part(path, '/', 1) ELSE '_root' END AS shard FROM paths", paths=_URL_PATH)
def _(r):
    return _url_paths(r).select("page_id", keys.shard_for("path").alias("shard"))


#: Codes that errors of the query have in turn, beside none.
_CODES = ("AccessDenied", "SlowDown", "InvalidBucketName", "TooManyRequests", "EntityTooLarge", "RequestTimeout", "NoSuchKey", "ThrottlingException", "RequestLimitExceeded", "Throttling", "SignatureDoesNotMatch", "InternalError")


@_query(
    "o_p12_retryable",
    f"""SELECT event_id, code, status, CASE WHEN code IN ('AccessDenied', 'AllAccessDisabled', 'InvalidAccessKeyId', 'SignatureDoesNotMatch', 'NoSuchBucket', 'InvalidBucketName', 'AccountProblem', 'InvalidObjectState', 'EntityTooLarge') THEN false
    WHEN status >= 400 AND status < 500 THEN coalesce(code IN ('RequestTimeout', 'SlowDown', 'Throttling', 'ThrottlingException'), false) ELSE true END AS retry
    FROM (SELECT event_id, [{", ".join(f"'{x}'" for x in _CODES)}][event_id % 13 + 1] AS code, CASE WHEN event_id % 7 <> 0 THEN 300 + event_id % 300 END AS status FROM events)""",
)
def _(r):
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 13).cast("int"))
    rows = r.table("events").select("event_id", code.alias("code"), F.when(F.col("event_id") % 7 != 0, 300 + F.col("event_id") % 300).alias("status"))
    return rows.select("event_id", "code", "status", keys.is_retryable("code", "status").alias("retry"))


@_query("o_p13_racy", "SELECT path, timestamp - mtime < 1.0 AS racy FROM cache", "cache")
def _(r):
    return r.cache.select("path", diff.racy(F.col("timestamp"), F.col("mtime")).alias("racy"))


@_query("o_p18_droppings", f"SELECT path, {_DROPPING} AS dropping FROM everything", "disk", everything=_EVERYTHING)
def _(r):
    return _everything(r).select("path", diff.is_dropping("path").alias("dropping"))


@_query("o_p19_escape", "SELECT page_id, replace(replace(replace(replace(replace(path, chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']'), '*', chr(92) || '*'), '?', chr(92) || '?') AS escaped FROM paths", paths=_URL_PATH)
def _(r):
    return _url_paths(r).select("page_id", keys.escape_ignore("path").alias("escaped"))


@_query("o_p21_display", "SELECT path, CASE WHEN starts_with(path, 'src2/') THEN substr(path, 6) ELSE path END AS shown FROM cur", "cur")
def _(r):
    return r.cur.select("path", keys.display("path", "src2").alias("shown"))


@_query("o_p22_human_size", "SELECT path, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS shown FROM (SELECT path, CAST(n_chars AS DOUBLE) * 97 AS n FROM cur)", "cur")
def _(r):
    return r.cur.select("path", keys.human_size(F.col("n_chars") * 97).alias("shown"))


@_query("o_p24_cone", f"SELECT path FROM cur WHERE {_IN_CONE('path')}", "cur")
def _(r):
    return profile.inside(r.cur.select("path"), CONE)


# Contents ---------------------------------------------------------------------------------------------------


@_query("o_f1_sha256", "SELECT path, sha256(text) AS hash FROM docs", "docs")
def _(r):
    return r.docs.select("path", content.sha256(F.col("text")).alias("hash"))


@_query("o_f2_md5", "SELECT path, md5(text) AS hash FROM docs", "docs")
def _(r):
    return r.docs.select("path", F.md5("text").alias("hash"))


@_query("o_f3_gzip_round_trip")
def _(r):
    back = content.gzip_decompress(content.gzip_compress(F.col("text").cast("binary")))
    return r.docs.select("path", F.sha2(back, 256).alias("hash"))


_ORACLES["o_f3_gzip_round_trip"] = _ORACLES["o_f1_sha256"]


@_query(
    "o_f5_split",
    "SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, least(1023, n - k * 1023) AS bytes FROM (SELECT *, unnest(range(0, CAST(ceil(n / 1023.0) AS BIGINT))) AS k FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents))",
)
def _(r):
    parts = r.docs.select("doc_id", F.explode(content.split(F.col("text"), 1024)).alias("c"))
    return parts.select("doc_id", F.col("c.chunk_index").alias("chunk_index"), F.octet_length("c.content").cast("long").alias("bytes"))


@_query("o_f6_is_chunked", "SELECT path, octet_length(encode(text)) > 1024 AS chunked FROM docs", "docs")
def _(r):
    return r.docs.select("path", content.is_chunked(F.octet_length("text"), 1024).alias("chunked"))


@_query("o_f8_verify", "SELECT c.path, c.hash, sha256(f.content) AS found FROM files f JOIN cur c USING (path) WHERE f.path LIKE 'src%' AND sha256(f.content) <> c.hash UNION ALL SELECT p.path, p.hash, sha256(f.content) FROM files f JOIN prev p USING (path) WHERE sha256(f.content) <> p.hash", "files", "cur", "prev")
def _(r):
    files = r.files.select("path", F.col("content").cast("binary").alias("content"))
    return store.verify(files, r.cur)[1].union(store.verify(files, r.prev)[1])


@_query("o_f10_backoff", "SELECT DISTINCT event_id % 8 AS attempt, least(power(2.0, event_id % 8 + 1), 30.0) AS seconds FROM events")
def _(r):
    rows = r.table("events").select((F.col("event_id") % 8).alias("attempt")).distinct()
    return rows.select("attempt", keys.backoff_ceiling("attempt").alias("seconds"))


@_query("o_p17_should_compress")  # SQL has no gzip; tests hold it against Python's
def _(r):
    return r.docs.select("path", content.should_compress(F.col("text")).alias("compress"))


@_query("o_s16_lfs_pointer", "SELECT path, starts_with(text, 'version https://git-lfs.github.com/spec/v1') AS pointer FROM docs", "docs")
def _(r):
    return r.docs.select("path", content.is_lfs_pointer(F.col("text")).alias("pointer"))


# Changes ------------------------------------------------------------------------------------------------------


@_query("o_w3_upsert", "SELECT path, hash FROM theirs UNION ALL SELECT path, hash FROM cur WHERE path NOT IN (SELECT path FROM theirs)", "theirs", "cur")
def _(r):
    return dml.upsert(r.cur.select("path", "hash"), r.theirs.select("path", "hash"))


@_query("o_w4_delete", "SELECT path, hash FROM cur WHERE path <> 'src1/en/1.txt'", "cur")
def _(r):
    return dml.forget(r.cur.select("path", "hash"), r.spark.createDataFrame([("src1/en/1.txt",)], "path string"))


@_query("o_w5_delete_pattern", "SELECT path, hash FROM cur WHERE NOT regexp_full_match(path, 'src1.*7[.]txt')", "cur")
def _(r):
    return dml.remove_matching(r.cur.select("path", "hash"), "src1*7.txt")


@_query("o_w7_record_hashes", "SELECT path, hash, size FROM (SELECT f.path, d.hash, f.size FROM disk d JOIN files f USING (path) UNION ALL SELECT path, hash, size FROM cache WHERE path NOT IN (SELECT f.path FROM disk d JOIN files f USING (path)))", "disk", "files", "cache")
def _(r):
    stats = r.files.select("path", "size", "mtime", "inode", F.lit(NOW).alias("timestamp"))
    return dml.record_hashes(r.cache, r.disk.select("path", "hash"), stats).select("path", "hash", "size")


@_query("o_w9_evict", "SELECT path, hash FROM cache WHERE path IN (SELECT path FROM disk) AND 1700060000.0 - timestamp <= 0.5 * 86400", "cache", "disk")
def _(r):
    return dml.evict_stale(r.cache, r.disk, 1_700_060_000.0, 0.5).select("path", "hash")


@_query("o_w11_victims", "SELECT DISTINCT key FROM stems WHERE base = 'p/assets/h3/gone.bin'", "stems")
def _(r):
    return store.delete_victims("p/assets/h3/gone.bin", r.store)


@_query("o_w16_shard", "SELECT path, hash FROM cur", "cur")
def _(r):
    """One file made into shards, and shards into one file."""
    import os

    from stowage.sources import manifest

    where, found = _local(_folder(r, "manifest")), _snapshots(r)
    os.makedirs(where)
    manifest.write_manifest(r.cur, f"{where}/.manifest.yaml", bucket="assets")
    found.shard_manifest(f"{where}/.manifest.yaml", "sharded")
    found.unshard("sharded", f"{where}/again.json")
    return manifest.read_manifest(r.spark, f"{where}/again.json")


@_query(
    "o_w20_ignore_upgrade",
    "SELECT '/' || path AS entry FROM cur WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src3/fr/') UNION SELECT unnest(['/src1/', '/src3/fr/', '/x.bin'])",
    "cur",
)
def _(r):
    added = r.spark.createDataFrame([("/src1/",), ("/src3/fr/",), ("/x.bin",)], "entry string")
    return dml.upgrade_ignores(r.cur.select(F.concat(F.lit("/"), "path").alias("entry")), added)


@_query("o_w21_deindex", "SELECT path FROM docs WHERE doc_id % 2 = 0 INTERSECT SELECT path FROM cur ORDER BY path", "docs", "cur")
def _(r):
    return diff.to_deindex(r.docs.where("doc_id % 2 = 0").select("path"), r.cur)


@_query(
    "o_w22_emptied_parents",
    "SELECT directory FROM (SELECT split_part(path, '/', 1) AS directory FROM gone UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM gone) EXCEPT SELECT directory FROM (SELECT split_part(path, '/', 1) AS directory FROM held UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM held)",
    "cur", gone="SELECT path FROM cur WHERE doc_id % 40 = 1 OR starts_with(path, 'src5/')", held="SELECT path FROM cur WHERE NOT (doc_id % 40 = 1 OR starts_with(path, 'src5/'))",
)
def _(r):
    gone = (F.col("doc_id") % 40 == 1) | F.col("path").startswith("src5/")
    return dml.emptied_parents(r.cur.where(gone), r.cur.where(~gone))


@_query("o_r1_claims_ttl", _LIVE_CLAIMS, "claims")
def _(r):
    return store.live_claims(r.claims, NOW)


# Scans ----------------------------------------------------------------------------------------------------------


@_query("o_s13_staged", "SELECT path FROM docs WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0", "docs")
def _(r):
    return diff.staged_files(r.docs.where("doc_id % 4 = 0").select("path", F.when(F.col("doc_id") % 12 == 0, "D").otherwise("M").alias("status")))


# Snapshots ------------------------------------------------------------------------------------------------------


def _folder(r: Relations, name: str) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    root = r.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if r.spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stowage-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _snapshots(r: Relations, *revisions: str):
    """Revisions, written."""
    from stowage.plans.snapshots import Snapshots

    found = Snapshots(r.spark, _folder(r, "snapshots"))
    for name in revisions:
        found.write(getattr(r, name), name)
    return found


@_query("o_s2_shard_scan", "SELECT path, hash FROM cur WHERE split_part(path, '/', 1) = 'src3'", "cur")
def _(r):
    return _snapshots(r, "cur").read("cur", ["src3"])


@_query("o_s4_shards", "SELECT DISTINCT split_part(path, '/', 1) AS shard FROM cur", "cur")
def _(r):
    return r.spark.createDataFrame([(x,) for x in _snapshots(r, "cur").shards("cur")], "shard string")


@_query("o_s5_shard_slice", "SELECT path, hash FROM cur WHERE split_part(path, '/', 1) IN ('src1', 'src7')", "cur")
def _(r):
    return _snapshots(r, "cur").read("cur", ["src1", "src7"])


@_query("o_s3_all_shards", "SELECT path, hash FROM cur", "cur")
def _(r):
    return _snapshots(r, "cur").read("cur")


@_query("o_s6_revision", "SELECT path, hash FROM prev WHERE split_part(path, '/', 1) IN ('src2', 'src4')", "prev")
def _(r):
    return _snapshots(r, "prev", "cur").read("prev", ["src2", "src4"])


@_query("o_w2_changed_shards", "SELECT path, hash FROM cur WHERE split_part(path, '/', 1) = 'src2' UNION ALL SELECT path, hash FROM prev WHERE split_part(path, '/', 1) <> 'src2'", "cur", "prev")
def _(r):
    found = _snapshots(r, "prev")
    found.write_changed("prev", r.cur, "next", ["src2"])
    return found.read("next")


# The rest of the inventory ---------------------------------------------------------------------------------------


@_query("o_s7_commit_range", "SELECT CAST(event_id AS BIGINT) AS ord, md5(CAST(event_id AS VARCHAR)) AS sha FROM events WHERE event_id > 100 AND event_id <= 700 ORDER BY ord")
def _(r):
    sha = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    commits = r.table("events").select(F.col("event_id").cast("long").alias("ord"), F.md5(F.col("event_id").cast("string")).alias("sha"))
    return diff.commit_range(commits, sha(100), sha(700))


@_query("o_s14_lfs_patterns", "SELECT '/' || path AS pattern FROM docs WHERE doc_id % 3 = 0", "docs")
def _(r):
    rest = F.when(F.col("doc_id") % 3 == 0, "  filter=lfs diff=lfs -text").otherwise(" text=auto")
    return dml.lfs_patterns(r.docs.select(F.concat(F.lit("/"), "path", rest).alias("value")))


#: A file whose lines are paths, some of them blank, with two end markers, of which the first is no end.
_FILE = "SELECT doc_id AS ord, CASE WHEN doc_id = 30 THEN '# begin' WHEN doc_id IN (10, 70, 90) THEN '# end' WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN '  ' ELSE path END AS line FROM docs"


def _file(r: Relations) -> DataFrame:
    line = F.when(F.col("doc_id") == 30, "# begin").when(F.col("doc_id").isin(10, 70, 90), "# end").when(F.col("doc_id") % 6 == 1, "").when(F.col("doc_id") % 6 == 2, "  ").otherwise(F.col("path"))
    return r.docs.select(F.col("doc_id").alias("ord"), line.alias("line"))


@_query(
    "o_s15_marked_block",
    "SELECT ord, line, CASE WHEN ord < 30 THEN 'before' WHEN ord < 70 THEN 'block' ELSE 'after' END AS section FROM lines WHERE ord NOT IN (30, 70) AND NOT (ord > 30 AND ord < 70 AND trim(line) = '')",
    "docs", lines=_FILE,
)
def _(r):
    return dml.split_block(_file(r), "# begin", "# end")


@_query("o_s15_unterminated_block", "SELECT ord, line, CASE WHEN ord < 30 THEN 'before' ELSE 'after' END AS section FROM lines WHERE ord <> 30", "docs", lines=_FILE)
def _(r):
    return dml.split_block(_file(r), "# begin", "# nowhere")


@_query("o_w8_forget", "SELECT path, hash FROM cache WHERE path NOT IN (SELECT path FROM disk)", "cache", "disk")
def _(r):
    return dml.forget(r.cache.select("path", "hash"), r.disk)


@_query(
    "o_w10_claim_release",
    f"SELECT base, claimed_at FROM (SELECT base, max(claimed_at) AS claimed_at FROM claims WHERE base NOT IN (SELECT base FROM mine) GROUP BY base UNION ALL SELECT base, {NOW} FROM mine) WHERE claimed_at >= {NOW} - 1000000 AND base NOT IN (SELECT base FROM mine WHERE doc_id % 14 = 0)",
    "claims", "cur", mine="SELECT DISTINCT 'p/assets/' || hash || '/' || path AS base, doc_id FROM cur WHERE doc_id % 7 = 0",
)
def _(r):
    bases = r.cur.where("doc_id % 7 = 0").select(keys.asset_key(PREFIX, "hash", "path").alias("base"), "doc_id")
    latest = r.claims.groupBy("base").agg(F.max("claimed_at").alias("claimed_at"))
    return dml.release(dml.claim(latest, bases, NOW), bases.where("doc_id % 14 = 0"), NOW, 1_000_000)


@_query(
    "o_w13_publish",
    "SELECT path, hash FROM done UNION ALL SELECT path, hash FROM cur WHERE path NOT IN (SELECT path FROM done)",
    "cur", "theirs", done="SELECT path, hash FROM theirs WHERE n_chars > 0 AND (n_chars <= 2000 OR doc_id % 5 <> 1)",
)
def _(r):
    n = F.ceil(F.col("n_chars") / 2000).cast("int")
    parts = r.theirs.where("n_chars > 0").select("path", "hash", "doc_id", "n_chars", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    landed = ~((F.col("n_chars") > 2000) & (F.col("doc_id") % 5 == 1) & (F.col("k") == 1))
    return dml.publish(r.cur, parts.select("path", "hash", landed.alias("landed")))


@_query(
    "o_w19_add_lines",
    "SELECT row_number() OVER (ORDER BY part, ord) AS ord, line FROM (SELECT line, min(part) AS part, min_by(ord, part * 1000000000 + ord) AS ord FROM (SELECT 0 AS part, doc_id AS ord, '/' || path AS line FROM cur UNION ALL SELECT 1, doc_id, '/' || path FROM theirs) GROUP BY line)",
    "cur", "theirs",
)
def _(r):
    return dml.add_lines(_lines(r.cur), _lines(r.theirs))


@_query("o_w19_remove_lines", "SELECT row_number() OVER (ORDER BY doc_id) AS ord, '/' || path AS line FROM cur WHERE path NOT IN (SELECT path FROM theirs)", "cur", "theirs")
def _(r):
    return dml.remove_lines(_lines(r.cur), _lines(r.theirs))


@_query(
    "o_w19_write_block",
    "SELECT row_number() OVER (ORDER BY part, ord) AS ord, line FROM (SELECT CASE WHEN ord <= 30 THEN 0 WHEN ord < 70 THEN 2 WHEN ord = 70 THEN 3 ELSE 4 END AS part, ord, line FROM lines WHERE NOT (ord > 30 AND ord < 70 AND trim(line) = '') UNION ALL SELECT 0, 29.5, '' FROM lines WHERE ord = 29 AND trim(line) <> '')",
    "docs", lines=_FILE,
)
def _(r):
    """Taken apart and put together again."""
    return dml.write_block(dml.split_block(_file(r), "# begin", "# end"), "# begin", "# end")


@_query(
    "o_w23_checkout",
    "SELECT c.path, c.hash FROM cur c LEFT JOIN disk d USING (path) WHERE starts_with(c.path, 'src3/') AND c.hash IS DISTINCT FROM d.hash",
    "cur", "disk",
)
def _(r):
    return diff.needs_download(globs.select(r.cur.select("path", "hash"), "src3"), r.disk).where("action = 'download'").select("path", "hash")


@_query("o_w24_track", "SELECT d.path, d.hash FROM disk d LEFT JOIN cur c USING (path) WHERE regexp_full_match(d.path, 'src4/(.*/)?[^/]*') AND d.hash IS DISTINCT FROM c.hash", "disk", "cur")
def _(r):
    return diff.needs_upload(r.disk.where(globs.matches("path", "src4/**/*") & ~keys.is_internal("path")), r.cur)


@_query("o_p2_filesystem_path", "SELECT page_id, CASE WHEN path <> '' AND NOT starts_with(path, '/') AND NOT ends_with(path, '/') AND NOT starts_with(path, '..') AND NOT contains(path, '/..') AND NOT contains(path, chr(92)) THEN '/work/' || path END AS place FROM paths", paths=_URL_PATH)
def _(r):
    return _url_paths(r).select("page_id", F.when(keys.is_valid_key("path"), F.concat(F.lit("/work/"), "path")).alias("place"))


@_query("o_p14_cache_hit", "SELECT f.path, f.size IS NOT DISTINCT FROM k.size AND f.mtime IS NOT DISTINCT FROM k.mtime AND f.inode IS NOT DISTINCT FROM k.inode AS hit FROM files f JOIN cache k USING (path)", "files", "cache")
def _(r):
    return diff.cached_hash(r.files, r.cache, trust_racy=True).join(r.cache.select("path"), "path").select("path", "hit")


@_query(
    "o_p20_ignore_pattern",
    "SELECT path, CASE WHEN doc_id % 3 = 0 THEN '/' || path || '/' WHEN doc_id % 3 = 1 THEN '/' || path WHEN doc_id % 2 = 0 THEN '/' || path || '*' ELSE '/' || path || '*/' END AS entry FROM docs",
    "docs",
)
def _(r):
    spec = F.when(F.col("doc_id") % 6 == 2, F.concat("path", F.lit("*"))).when(F.col("doc_id") % 6 == 5, F.concat("path", F.lit("*/"))).when(F.col("doc_id") % 3 == 0, F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    return r.docs.select("path", dml.ignore_pattern(spec, F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1).alias("entry"))


@_query("o_p23_precedence", "SELECT doc_id, CASE WHEN given <> '' THEN given WHEN stored IS NOT NULL THEN stored ELSE 'default' END AS value FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '' END AS given, CASE doc_id % 4 WHEN 0 THEN source WHEN 2 THEN '' END AS stored FROM documents)")
def _(r):
    """An empty setting of the caller says nothing; an empty one in the file is one."""
    given = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "")
    stored = F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 2, "")
    return r.docs.select("doc_id", keys.setting(given, stored, F.lit("default")).alias("value"))


@_query("o_p25_reachable_entries", "SELECT path FROM cur WHERE split_part(path, '/', 1) IN ('src1', 'src3') OR NOT contains(path, '/')", "cur")
def _(r):
    return r.cur.select("path").where(keys.shard_for("path").isin(profile.reachable_shards(CONE)))


#: The lines of an attributes file.
_ATTRIBUTES = ("*7.txt filter=lfs diff=lfs -text", "# src2/** filter=lfs", "src1/**/*.txt -text filter=lfs", "src4/** text", "")


@_query("o_a10_lfs_bytes", "SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM docs WHERE starts_with(path, 'src1/') OR ends_with(path, '7.txt')", "docs")
def _(r):
    attributes = r.spark.createDataFrame([(x,) for x in _ATTRIBUTES], "value string")
    return dml.lfs_bytes(r.docs.select("path", F.octet_length("text").cast("long").alias("size")), attributes)


@_query("o_a16_distinct_pairs", "SELECT path, hash FROM cur UNION SELECT path, hash FROM prev UNION SELECT path, hash FROM theirs", "cur", "prev", "theirs")
def _(r):
    return diff.distinct_pairs(r.cur, r.prev, r.theirs)


@_query(
    "o_t4_hidden_limit",
    f"SELECT path FROM everything WHERE split_part(path, '/', 1) IN (SELECT split_part(path, '/', 1) FROM cur) AND path NOT IN (SELECT path FROM cur) AND NOT {_DROPPING} AND NOT contains(path, '/.git/') ORDER BY path LIMIT 20",
    "disk", "cur", everything=_EVERYTHING,
)
def _(r):
    directories = r.cur.select(keys.shard_for("path").alias("directory")).distinct()
    return diff.hidden(_everything(r), directories, r.cur, limit=20)


@_query("o_t5_chunk_order", "SELECT manifest_key, list(chunk_index ORDER BY chunk_index)::VARCHAR AS chunks FROM chunks GROUP BY manifest_key", "chunks")
def _(r):
    ordered = F.array_sort(F.collect_list("chunk_index"))
    return r.chunks.groupBy("manifest_key").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x.cast("string")), ", "), F.lit("]")).alias("chunks"))


@_query("o_u6_key_union", "SELECT path AS key FROM cur UNION SELECT path FROM prev UNION SELECT path FROM theirs", "cur", "prev", "theirs")
def _(r):
    return merge.key_union(*[x.withColumnRenamed("path", "key") for x in (r.cur, r.prev, r.theirs)])


@_query("o_u7_unknown_keys", "SELECT path AS key FROM theirs EXCEPT SELECT path FROM cur", "theirs", "cur")
def _(r):
    return merge.unknown_keys(*[x.withColumnRenamed("path", "key") for x in (r.theirs, r.cur)])


@_query("o_u8_scan_union", f"SELECT path FROM cur WHERE {_IN_CONE('path')} UNION SELECT path FROM prev WHERE path NOT IN (SELECT path FROM cur)", "cur", "prev")
def _(r):
    return profile.inside(r.cur.select("path"), CONE).union(diff.dropped(r.prev, r.cur).select("path")).distinct()


@_query(
    "o_w15_download",
    "SELECT manifest_key AS path, sha256(string_agg(text, '' ORDER BY chunk_index)) = sha256(string_agg(text, '' ORDER BY chunk_index) || CASE WHEN CAST(manifest_key AS BIGINT) % 5 = 0 THEN '!' ELSE '' END) AS whole FROM chunks GROUP BY manifest_key",
    "chunks",
)
def _(r):
    files = store.reassemble(r.chunks).select(F.col("manifest_key").alias("path"), "content")
    spoiled = F.when(F.col("path").cast("long") % 5 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    good, bad = store.verify(files, files.select("path", F.sha2(spoiled, 256).alias("hash")))
    return good.select("path", F.lit(True).alias("whole")).union(bad.select("path", F.lit(False)))


@_query("o_w18_lfs_import", "SELECT path, starts_with(content, 'version https://git-lfs.github.com/spec/v1') AS pointer FROM files WHERE starts_with(path, 'src1/') OR ends_with(path, '7.txt')", "files")
def _(r):
    return dml.lfs_import(r.files, r.spark.createDataFrame([(x,) for x in _ATTRIBUTES], "value string"))


@_query("o_p16_stat_changed", "SELECT k.path, f.path IS NULL OR f.size IS DISTINCT FROM k.size OR f.mtime IS DISTINCT FROM k.mtime OR f.inode IS DISTINCT FROM k.inode AS changed FROM cache k LEFT JOIN files f USING (path)", "cache", "files")
def _(r):
    return diff.changed_since(r.cache, r.files)


@_query(
    "o_r2_incremental",
    f"SELECT path FROM everything WHERE path NOT IN (SELECT path FROM cur) AND NOT {_DROPPING} AND regexp_replace(path, '/[^/]*$', '') IN (SELECT source || '/' || lang FROM docs GROUP BY 1 HAVING max(doc_id) % 2 = 0)",
    "disk", "cur", everything=_EVERYTHING,
)
def _(r):
    """Of all tracked directories only those whose time is after the last scan's are looked into."""
    times = r.docs.groupBy(F.concat_ws("/", "source", "lang").alias("directory")).agg((F.lit(1000.0) + F.max("doc_id") % 2).alias("mtime"))
    directories = r.docs.select(F.col("source").alias("directory")).distinct()
    return diff.hidden(_everything(r), directories, r.cur, changed=diff.recent(times.withColumn("mtime", 2001.0 - F.col("mtime")), 1000.0))


# Files that are written and read -----------------------------------------------------------------------------------


def _local(where: str) -> str:
    return where.removeprefix("file://")


def _working_copy(r: Relations) -> str:
    """A folder with a file for each of `disk`, and others that a lister has to know."""
    import os

    root = _folder(r, "copy")
    target = _local(root)

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = os.path.join(target, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("#edit"))).otherwise(F.col("text"))
    files = r.docs.where("doc_id % 17 <> 2").select("path", text.cast("binary").alias("content"))
    files = files.union(r.spark.createDataFrame([("src1/.hidden/a.txt", bytearray(b"a")), ("src1/_empty", bytearray()), (".git/config", bytearray(b"no"))], "path string, content binary"))
    files.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


#: What a user names by src1/**/*1.txt, by the directory src3/fr and by the pattern s?c4, which names a directory.
_NAMED = "regexp_full_match(path, 'src1/(.*/)?[^/]*1[.]txt') OR starts_with(path, 'src3/fr/') OR starts_with(path, 'src4/')"


@_query("o_s9_files", f"SELECT path, octet_length(encode(CASE WHEN doc_id % 13 = 0 THEN text || '#edit' ELSE text END)) AS size FROM docs WHERE doc_id % 17 <> 2 AND ({_NAMED})", "docs")
def _(r):
    from stowage.sources import files

    root = _local(_working_copy(r))
    found = [files.resolve(r.spark, root, spec) for spec in ("src1/**/*1.txt", "src3/fr", "s?c4", "none/*.x")]
    return found[0].union(found[1]).union(found[2]).union(found[3]).select("path", "size")


@_query("o_s9_all_files", "SELECT path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '#edit' ELSE text END) AS hash FROM docs WHERE doc_id % 17 <> 2 UNION ALL SELECT 'src1/.hidden/a.txt', sha256('a') UNION ALL SELECT 'src1/_empty', sha256('')", "docs")
def _(r):
    from stowage.sources import files

    root = _local(_working_copy(r))
    return files.hash_files(files.list_files(r.spark, root), root)


_UPLOADED = "SELECT path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '#edit' ELSE text END) AS hash FROM docs WHERE doc_id % 17 <> 2 AND starts_with(path, 'src2/')"


@_query("o_w12_upload", f"SELECT *, true AS landed FROM ({_UPLOADED})", "docs")
def _(r):
    from stowage.operators import transfer
    from stowage.sources import files

    root, to = _local(_working_copy(r)), _folder(r, "store")
    return transfer.upload(files.resolve(r.spark, root, "src2"), root, to, PREFIX, 1500).select("path", "hash", "landed")


@_query("o_w14_download", f"SELECT *, true AS ok FROM ({_UPLOADED})", "docs")
def _(r):
    """Up, listed, located and down again, with the digests of the files that arrive."""
    from stowage.operators import transfer
    from stowage.sources import files

    root, to, back = _local(_working_copy(r)), _folder(r, "store"), _local(_folder(r, "back"))
    sent = transfer.upload(files.resolve(r.spark, root, "src2"), root, to, PREFIX, 1500).select("path", "hash")
    entries = r.spark.createDataFrame(sent.toArrow())
    located = store.locate(entries, files.inventory(r.spark, _local(to)), PREFIX).join(entries, "path")
    fetched = r.spark.createDataFrame(transfer.download(located, to, back, PREFIX).toArrow())
    return files.hash_files(files.list_files(r.spark, back), back).join(fetched.select("path", "ok"), "path")


@_query("o_s8_objects", f"SELECT count(*) FILTER (WHERE starts_with(hash, '0')) AS n FROM ({_UPLOADED})", "docs")
def _(r):
    """Assets of a written store by a prefix of their keys."""
    from stowage.operators import transfer
    from stowage.sources import files

    root, to = _local(_working_copy(r)), _folder(r, "store")
    transfer.upload(files.resolve(r.spark, root, "src2"), root, to, PREFIX).agg(F.count(F.lit(1))).collect()
    return files.inventory(r.spark, _local(to), f"{PREFIX}/assets/0").agg(F.count(F.lit(1)).alias("n"))


@_query("o_s1_manifest", "SELECT path, hash FROM cur", "cur")
def _(r):
    """Written as YAML and read by the source."""
    import os

    from stowage.sources import manifest

    where = _local(_folder(r, "manifest"))
    os.makedirs(where)
    manifest.write_manifest(r.cur, f"{where}/.manifest.yaml", bucket="assets")
    return manifest.read_manifest(r.spark, manifest.manifest_path(where))


@_query("o_w17_convert", "SELECT path, hash FROM cur", "cur")
def _(r):
    """Written as JSON, made into YAML."""
    import os

    from stowage.sources import manifest

    where = _local(_folder(r, "manifest"))
    os.makedirs(where)
    manifest.write_manifest(r.cur, f"{where}/.manifest.json", bucket="assets")
    manifest.convert(r.spark, manifest.manifest_path(where), f"{where}/.manifest.yaml")
    return manifest.read_manifest(r.spark, manifest.manifest_path(where))


@_query("o_w1_manifest_order", "SELECT row_number() OVER (ORDER BY path) AS nth, path FROM cur", "cur")
def _(r):
    """The lines of a written manifest, in their order."""
    import os

    from stowage.sources import manifest

    where = _local(_folder(r, "manifest"))
    os.makedirs(where)
    manifest.write_manifest(r.cur, f"{where}/m.json")
    lines = [x.partition('": "')[0].lstrip('"') for x in open(f"{where}/m.json").read().splitlines() if '": "' in x]
    return r.spark.createDataFrame(list(enumerate(lines, 1)), "nth long, path string")


@_query("o_s10_cache_scan", "SELECT path, hash, size, mtime, inode, timestamp FROM cache", "cache")
def _(r):
    """Saved because it has changed, and read from its file."""
    import os

    from stowage.sources import cache

    where = _local(_folder(r, "cache"))
    os.makedirs(where)
    held = cache.HashCache(r.spark, f"{where}/cache.yaml")
    held.set(r.cache)
    held.save()
    return cache.HashCache(r.spark, f"{where}/cache.yaml").load()


@_query("o_s11_claims_scan", "SELECT base, max(claimed_at) AS claimed_at FROM claims GROUP BY base", "claims")
def _(r):
    import os

    from stowage.sources import cache

    where = _local(_folder(r, "claims"))
    os.makedirs(where)
    cache.write_claims(r.claims, f"{where}/claims.yaml")
    return cache.read_claims(r.spark, f"{where}/claims.yaml")


@_query("o_p15_changed_during_hash", "SELECT f.path, f.size IS DISTINCT FROM g.size OR g.path IS NULL AS changed FROM files f LEFT JOIN (SELECT path, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM docs WHERE doc_id % 6 <> 0) g USING (path)", "files", "docs")
def _(r):
    after = r.docs.where("doc_id % 6 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), (1_700_000_000.0 + F.col("doc_id") * 100.0).alias("mtime"), (F.col("doc_id") + 1000).alias("inode"))
    return diff.changed_since(r.files, after)


@_query("o_r3_on_move", "SELECT path, hash FROM cur WHERE path NOT IN (SELECT path FROM prev WHERE prev.hash = cur.hash)", "cur", "prev")
def _(r):
    """What an action that follows the pointer is given: the entries of the new revision that the one before hasn't."""
    found, checkpoint, seen = _snapshots(r, "prev", "cur"), _folder(r, "trigger"), []
    found.advance(None, "prev")
    found.on_move(lambda before, after: seen.append((before, after)), checkpoint)
    found.advance("prev", "cur")
    found.on_move(lambda before, after: seen.append((before, after)), checkpoint)
    before, after = seen[-1]
    return diff.delta(found.read(after), found.read(before)).select("path", "hash")


@_query("o_r4_completed_files", "SELECT manifest_key, count(*) AS n_chunks FROM chunks WHERE CAST(manifest_key AS BIGINT) % 3 <> 0 GROUP BY manifest_key", "chunks")
def _(r):
    """Chunks come in any order from a stream; of every third file one is lacking."""
    from stowage.streaming import claims

    where, last = _folder(r, "chunks"), F.max("chunk_index").over(Window.partitionBy("manifest_key"))
    rows = r.chunks.withColumn("last", last).where("cast(manifest_key as bigint) % 3 <> 0 or chunk_index < last")
    rows.select("manifest_key", "chunk_index", (F.col("last") + 1).cast("int").alias("num_chunks"), F.lit(NOW).cast("timestamp").alias("landed_at")).orderBy(F.xxhash64("manifest_key", "chunk_index")).write.parquet(where)
    stream = r.spark.readStream.schema("manifest_key string, chunk_index long, num_chunks int, landed_at timestamp").option("maxFilesPerTrigger", 2).parquet(where)
    to = _folder(r, "completed")
    query = claims.completed_files(stream).writeStream.format("parquet").option("path", to).option("checkpointLocation", _folder(r, "completed-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return r.spark.read.schema("manifest_key string, n_chunks long").parquet(to)


@_query("o_s12_index", f"SELECT path FROM docs WHERE doc_id % 17 <> 2 AND ({_NAMED})", "docs")
def _(r):
    """A repository of some files of the working copy, and what its index holds."""
    import subprocess

    from stowage.sources import index

    root = _local(_working_copy(r))
    subprocess.run(["git", "init", "-q", root], check=True)
    subprocess.run(["git", "-C", root, "add", "src1/**/*1.txt", "src3/fr", "src4"], check=True)
    return index.read_index(r.spark, root)


@_query("o_s17_config", "SELECT * FROM (VALUES ('bucket_name', 'assets', true), ('max_workers', '4', true), ('future_option', NULL, false)) AS t(key, value, known)")
def _(r):
    """A settings file with an unknown key: what it sets, and what is reported and left out."""
    import os

    from stowage.sources import config

    where = _local(_folder(r, "config"))
    os.makedirs(f"{where}/a/b")
    with open(f"{where}/.stowage.yaml", "w") as f:
        f.write("bucket_name: assets\nmax_workers: 4\nfuture_option: 1\n")
    settings, unknown = config.load(config.find(f"{where}/a/b"))
    rows = [(k, str(v), True) for k, v in settings.items() if v and config.DEFAULTS[k] != v] + [(k, None, False) for k in unknown]
    return r.spark.createDataFrame(rows, "key string, value string, known boolean")


@_query("o_w6_save_if_changed", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) AS t(step, written)")
def _(r):
    """Saved after a change, not again, after the next change, and not after it was read."""
    import os

    from stowage.sources import cache

    where = _local(_folder(r, "cache"))
    os.makedirs(where)
    held, wrote = cache.HashCache(r.spark, f"{where}/cache.json"), []
    held.set(r.cache)
    wrote += [held.save(), held.save()]
    held.set(dml.forget(held.load(), r.disk))
    wrote.append(held.save())
    held.load(force=True)
    wrote.append(held.save())
    return r.spark.createDataFrame(list(enumerate(wrote, 1)), "step int, written boolean")

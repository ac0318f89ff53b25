"""The relations of an asset collection, derived from the driver's tables.

Documents are the assets: path is source/lang/doc_id.txt and hash the SHA-256 of the text. Revisions,
working copy and store leave out or alter rows by doc_id. Each relation comes as a DataFrame and as
the SQL of a common table expression that says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import ship

PREFIX = "p"
CHUNK_CHARS = 2000
NAMES = ("docs", "cur", "prev", "disk", "theirs", "cache", "files", "store", "claims", "timeline", "chunks")
#: The present, for everything that expires: 2024-01-15T00:00:00Z.
NOW = 1_705_276_800.0


def _micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({column} AS timestamp_ntz))")


#: Folders of relations that keep_relations() has written, by the folder of their tables.
_KEPT: dict[str, str] = {}


def keep_relations(spark: SparkSession, root: str, to: str) -> None:
    """Write all relations over the tables in `root` once, for all queries of this process that follow: those then time operators, not the making of their input."""
    _KEPT.pop(root, None)
    held = Relations(spark, root)
    for name in NAMES:
        getattr(held, name).write.parquet(f"{to}/{name}")
    _KEPT[root] = to


def _relation(build):
    """A relation that is read where keep_relations() has written it, and else built."""

    def get(self):
        kept = _KEPT.get(self.root)
        return self.spark.read.parquet(f"{kept}/{build.__name__}") if kept else build(self)

    get.__doc__ = build.__doc__
    return property(get)


class Relations:
    """Relations over one folder of tables; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @_relation
    def docs(self) -> DataFrame:
        path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").withColumn("path", path)

    def _edited(self, rows: DataFrame, modulus: int, suffix: str) -> DataFrame:
        text = F.when(F.col("doc_id") % modulus == 0, F.concat("text", F.lit(suffix))).otherwise(F.col("text"))
        return rows.select("path", F.sha2(text, 256).alias("hash"), "doc_id", "n_chars")

    @_relation
    def cur(self) -> DataFrame:
        return self.docs.where("doc_id % 9 <> 3").select("path", F.sha2("text", 256).alias("hash"), "doc_id", "n_chars")

    @_relation
    def prev(self) -> DataFrame:
        return self._edited(self.docs.where("doc_id % 11 <> 5"), 7, "#v0")

    @_relation
    def disk(self) -> DataFrame:
        return self._edited(self.docs.where("doc_id % 17 <> 2"), 13, "#edit")

    @_relation
    def theirs(self) -> DataFrame:
        return self._edited(self.docs.where("doc_id % 10 <> 4"), 7, "#v1")

    @_relation
    def cache(self) -> DataFrame:
        """Hashes taken for most files; some are out of date, racy or of another inode."""
        rows = self.docs.where("doc_id % 6 <> 1")
        stale = F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("#old"))).otherwise(F.col("text"))
        mtime = 1_700_000_000.0 + F.col("doc_id") * 100.0
        return rows.select(
            "path",
            F.sha2(stale, 256).alias("hash"),
            F.when(F.col("doc_id") % 8 == 0, F.col("n_chars") + 4).otherwise(F.col("n_chars")).alias("size"),
            mtime.alias("mtime"),
            (F.col("doc_id") + 1000).alias("inode"),
            (mtime + F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(60.0)).alias("timestamp"),
        )

    @_relation
    def files(self) -> DataFrame:
        """Files with stat and content."""
        rows = self.docs.where("doc_id % 17 <> 2")
        return rows.select("path", "n_chars", F.col("n_chars").alias("size"), (1_700_000_000.0 + F.col("doc_id") * 100.0).alias("mtime"), (F.col("doc_id") + 1000).alias("inode"), F.col("text").alias("content"))

    @_relation
    def store(self) -> DataFrame:
        """Objects: raw or .gz, whole or in chunks, some with a hole, and look-alikes that belong to nothing."""
        both = self.cur.union(self.prev).distinct().where("doc_id % 19 <> 4")
        stem = F.concat(F.lit(f"{PREFIX}/assets/"), "hash", F.lit("/"), "path", F.when(F.col("n_chars") % 2 == 0, ".gz").otherwise(""))
        n = F.ceil(F.col("n_chars") / CHUNK_CHARS).cast("int")
        rows = both.select(stem.alias("stem"), "doc_id", "n_chars", n.alias("n"))
        whole = rows.where("n <= 1").select(F.col("stem").alias("key"), F.col("n_chars").alias("size"))
        parts = rows.where("n > 1").select("stem", "doc_id", "n_chars", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        parts = parts.where(~((F.col("n") >= 3) & (F.col("doc_id") % 5 == 1) & (F.col("k") == 1)))
        size = F.least(F.lit(CHUNK_CHARS).cast("long"), F.col("n_chars") - F.col("k") * CHUNK_CHARS)
        parts = parts.select(F.concat("stem", F.lit(".chunk"), F.col("k").cast("string")).alias("key"), size.alias("size"))
        # Some raw chunks, with and without a hole, have a compressed object beside them.
        both = rows.where("n > 1 and n_chars % 2 = 1 and doc_id % 3 <> 0").select(F.concat("stem", F.lit(".gz")).alias("key"), F.lit(1).cast("long").alias("size"))
        odd = self.spark.createDataFrame([(k, s) for k, s in ODD_KEYS], "key string, size long")
        return whole.union(parts).union(both).union(odd)

    @_relation
    def claims(self) -> DataFrame:
        """Claims on the base keys of every fourth entry, at the times of events."""
        times = self.table("events").select((F.col("event_id") * 4).alias("doc_id"), _micros("ts").alias("us"))
        rows = self.prev.join(times, "doc_id")
        return rows.select(F.concat(F.lit(f"{PREFIX}/assets/"), "hash", F.lit("/"), "path").alias("base"), (F.floor(F.col("us") / 1_000_000)).cast("double").alias("claimed_at"))

    @_relation
    def timeline(self) -> DataFrame:
        """stage, ts (microseconds), seq and delta: starts and ends of tasks."""
        return self.table("events").select(F.col("event_type").alias("stage"), _micros("ts").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"))

    @_relation
    def chunks(self) -> DataFrame:
        """Turns of conversations as the chunks of files."""
        return self.table("conversations").select(F.col("conv_id").cast("string").alias("manifest_key"), F.col("turn").alias("chunk_index"), F.col("text").cast("binary").alias("content"))


#: Fixed keys that look like assets and aren't, and chunked ones that are.
ODD_KEYS = (
    ("p/assets/h/a.bin.gz2", 5),
    ("p/assets/h/a.bin.chunkX", 6),
    ("p/assets/onlyhash", 7),
    ("other/assets/abc/f.gz", 8),
    ("p/short", 9),
    ("p/assets/h3/gone.bin.gz.chunk0", 10),
    ("p/assets/h3/gone.bin.gz.chunk1", 11),
)

_ODD = ", ".join(f"('{k}', {s})" for k, s in ODD_KEYS)

#: The same relations in SQL. Regular expressions are written without backslashes.
CTES = {
    "docs": "SELECT *, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents",
    "cur": "SELECT path, sha256(text) AS hash, doc_id, n_chars FROM docs WHERE doc_id % 9 <> 3",
    "prev": "SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '#v0' ELSE text END) AS hash, doc_id, n_chars FROM docs WHERE doc_id % 11 <> 5",
    "disk": "SELECT path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '#edit' ELSE text END) AS hash, doc_id, n_chars FROM docs WHERE doc_id % 17 <> 2",
    "theirs": "SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '#v1' ELSE text END) AS hash, doc_id, n_chars FROM docs WHERE doc_id % 10 <> 4",
    "cache": """SELECT path, sha256(CASE WHEN doc_id % 8 = 0 THEN text || '#old' ELSE text END) AS hash,
        CASE WHEN doc_id % 8 = 0 THEN n_chars + 4 ELSE n_chars END AS size, CAST(1700000000.0 + doc_id * 100.0 AS DOUBLE) AS mtime, doc_id + 1000 AS inode,
        CAST(1700000000.0 + doc_id * 100.0 + CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 60.0 END AS DOUBLE) AS timestamp FROM docs WHERE doc_id % 6 <> 1""",
    "files": "SELECT path, n_chars, n_chars AS size, CAST(1700000000.0 + doc_id * 100.0 AS DOUBLE) AS mtime, doc_id + 1000 AS inode, text AS content FROM docs WHERE doc_id % 17 <> 2",
    "stored": f"""SELECT 'p/assets/' || hash || '/' || path || CASE WHEN n_chars % 2 = 0 THEN '.gz' ELSE '' END AS stem, doc_id, n_chars, CAST(ceil(n_chars / {CHUNK_CHARS}.0) AS INTEGER) AS n
        FROM (SELECT * FROM cur UNION SELECT * FROM prev) WHERE doc_id % 19 <> 4""",
    "store": f"""SELECT stem AS key, n_chars AS size FROM stored WHERE n <= 1
        UNION ALL SELECT stem || '.chunk' || CAST(k AS VARCHAR), least({CHUNK_CHARS}, n_chars - k * {CHUNK_CHARS}) FROM (SELECT *, unnest(range(0, n)) AS k FROM stored WHERE n > 1) WHERE NOT (n >= 3 AND doc_id % 5 = 1 AND k = 1)
        UNION ALL SELECT stem || '.gz', 1 FROM stored WHERE n > 1 AND n_chars % 2 = 1 AND doc_id % 3 <> 0
        UNION ALL SELECT * FROM (VALUES {_ODD})""",
    "stems": """SELECT DISTINCT key, size, base FROM (SELECT key, size, unnest([key, regexp_replace(key, '[.]chunk[0-9]+$', ''), regexp_replace(key, '[.]gz$', ''),
        regexp_replace(regexp_replace(key, '[.]chunk[0-9]+$', ''), '[.]gz$', '')]) AS base FROM store)""",
    "claims": """SELECT 'p/assets/' || p.hash || '/' || p.path AS base, CAST(floor(epoch_us(e.ts) / 1000000) AS DOUBLE) AS claimed_at FROM prev p JOIN events e ON p.doc_id = e.event_id * 4""",
    "timeline": "SELECT event_type AS stage, epoch_us(ts) AS ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta FROM events",
    "chunks": "SELECT CAST(conv_id AS VARCHAR) AS manifest_key, turn AS chunk_index, text FROM conversations",
}
_NEEDS = {"cur": ("docs",), "prev": ("docs",), "disk": ("docs",), "theirs": ("docs",), "cache": ("docs",), "files": ("docs",), "stored": ("cur", "prev"), "store": ("stored",), "stems": ("store",), "claims": ("prev",)}


def with_relations(query: str, *names: str, **more: str) -> str:
    """`query` behind the named relations, those that they need, and `more` in order."""
    found: dict[str, str] = {}

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        found.setdefault(name, CTES[name])

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (found | more).items()) + "\n" + query

"""Paths, manifest keys and storage keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_SHARD = "_root"
#: What a working copy keeps for itself: directories, base names and an ending. A collection with other names passes its own.
INTERNAL_DIRS = (".git", ".stowage")
INTERNAL_NAMES = (".manifest.yaml", ".manifest.json", ".manifest_cache.yaml", ".manifest_cache.json")
INTERNAL_ENDING = ".lock"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asset_key(prefix: str, hash: Column | str, path: Column | str) -> Column:
    """The storage stem of an entry."""
    return F.concat_ws("/", F.lit(prefix), F.lit("assets"), _col(hash), _col(path))


def is_asset_key(prefix: str, key: Column | str) -> Column:
    """Whether a key has the shape of an asset: a hash and something behind it under the prefix."""
    base = f"{prefix}/assets/"
    return _col(key).startswith(base) & F.substring(_col(key), len(base) + 1, 1 << 30).rlike(r"\A[^/]+/(?s:.+)\z")


def shard_for(path: Column | str) -> Column:
    """The first path component; ROOT_SHARD for a top-level file."""
    path = _col(path)
    first = F.substring_index(path, "/", 1)
    return F.when(path.contains("/") & (first != ""), first).otherwise(ROOT_SHARD)


def normalise(path: Column | str) -> Column:
    """A relative path without "." and ".."; null where it would leave the root or is absolute."""
    path = _col(path)
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x != "..", F.concat(done, F.array(x))).when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    return F.when(~path.startswith("/"), F.array_join(folded, "/"))


def is_valid_key(path: Column | str) -> Column:
    """Non-empty, relative, inside the root, with forward slashes only."""
    path = _col(path)
    bad = (path == "") | path.startswith("/") | path.endswith("/") | path.startswith("..") | path.contains("/..") | path.contains("\\")
    return F.coalesce(~bad, F.lit(False))


def from_input(path: Column | str, cwd: str) -> Column:
    """A user's path as a key, relative to `cwd` unless it already lies there."""
    path = _col(path)
    if not cwd:
        return normalise(path)
    inside = (path == cwd) | path.startswith(f"{cwd}/")
    return normalise(F.when(inside, path).otherwise(F.concat(F.lit(f"{cwd}/"), path)))


def display(path: Column | str, cwd: str) -> Column:
    """A key as shown to a user in `cwd`."""
    path = _col(path)
    return F.when(path.startswith(f"{cwd}/"), F.substring(path, len(cwd) + 2, 1 << 30)).otherwise(path) if cwd else path


def in_internal_dir(path: Column | str, dirs=INTERNAL_DIRS) -> Column:
    """Whether a path lies in a directory of the tool's own."""
    parts = F.split(_col(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, dirs)))


def is_internal(path: Column | str, dirs=INTERNAL_DIRS, names=INTERNAL_NAMES, ending: str = INTERNAL_ENDING) -> Column:
    """Whether a path is the tool's own."""
    path = _col(path)
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, dirs))) | F.element_at(parts, -1).isin(*names) | path.endswith(ending)


def escape_ignore(path: Column | str) -> Column:
    """A path as a literal ignore pattern."""
    return F.regexp_replace(_col(path), r"([\[\]*?\\])", r"\\$1")


def human_size(size: Column | str) -> Column:
    """Bytes in steps of 1024, one decimal."""
    size = _col(size).cast("double")
    out, units = None, ("B", "KB", "MB", "GB", "TB")
    for k, unit in enumerate(units):
        text = F.format_string(f"%.1f {unit}", F.bround(size / 1024**k, 1))
        out = F.when(size < 1024 ** (k + 1), text) if out is None else out.when(size < 1024 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1f PB", F.bround(size / 1024**5, 1)))


def stems_of(key: Column | str) -> Column:
    """The at most four base keys that an object can belong to: without a chunk number, without .gz, without both."""
    key = _col(key)
    whole = F.regexp_replace(key, r"[.]chunk[0-9]+\z", "")
    bare = lambda x: F.regexp_replace(x, r"[.]gz\z", "")
    return F.array_distinct(F.array(key, whole, bare(key), bare(whole)))


def chunk_index(key: Column | str) -> Column:
    """The chunk number of an object; null for one that is whole."""
    found = F.regexp_extract(_col(key), r"[.]chunk([0-9]+)\z", 1)
    return F.when(found != "", found.cast("int"))


def ancestors(path: Column | str) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(_col(path), "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


#: Error codes of a store that no second attempt mends, and those of client errors that one may.
LASTING_CODES = ("AccessDenied", "AllAccessDisabled", "InvalidAccessKeyId", "SignatureDoesNotMatch", "NoSuchBucket", "InvalidBucketName", "AccountProblem", "InvalidObjectState", "EntityTooLarge")
PASSING_CODES = ("RequestTimeout", "SlowDown", "Throttling", "ThrottlingException")


def is_retryable(code: Column | str, status: Column | str) -> Column:
    """Whether an error may pass: neither a lasting one, nor a client error other than throttling and a timeout."""
    code = F.coalesce(_col(code), F.lit(""))
    client = F.coalesce(_col(status).between(400, 499), F.lit(False))
    return ~code.isin(*LASTING_CODES) & (~client | code.isin(*PASSING_CODES))


def setting(given: Column, stored: Column, default: Column) -> Column:
    """What holds of a caller's setting, a file's and the default: the caller's if it says anything, else the file's if it is there."""
    return F.when(given != "", given).otherwise(F.coalesce(stored, default))


def backoff_ceiling(attempt: Column | str, most: float = 30.0) -> Column:
    """Seconds that a retry waits at most."""
    return F.least(F.pow(F.lit(2.0), _col(attempt) + 1), F.lit(most))

"""Three dialects of path patterns, compiled to Java regular expressions.

segment: "*" and "?" stay within a path component, "[...]" is a class.
recursive: "**" crosses components, all else as in segment but "[" is literal.
fnmatch: "*" crosses components.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLOB_CHARS = "*?["


def has_glob(pattern: str) -> bool:
    return any(c in pattern for c in GLOB_CHARS)


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """The character class that begins at `at`, and where it ends."""
    start = at + 1 + (pattern[at + 1 : at + 2] in ("!", "^"))
    end = pattern.find("]", start + 1)
    if end < 0:
        return None
    body = re.sub(r"([\\\[\]&^~])", r"\\\1", pattern[start:end])
    return f"[{'^' if start > at + 1 else ''}{body}]", end + 1


def _flat(pattern: str, any_char: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and (found := _class(pattern, at)):
            out.append(found[0])
            at = found[1]
            continue
        out.append(f"{any_char}*" if c == "*" else any_char if c == "?" else re.escape(c))
        at += 1
    return "".join(out)


_WILD = re.compile(r"\*\*/|/\*\*|\*\*|\*|\?|[^*?/]+|/")
_MEANS = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def compile_glob(pattern: str, dialect: str | None = None) -> str:
    """The regular expression of a pattern; by default recursive where it has "**", else segment."""
    dialect = dialect or ("recursive" if "**" in pattern else "segment")
    if dialect == "segment":
        body = _flat(pattern, "[^/]")
    elif dialect == "fnmatch":
        body = _flat(pattern, "(?s:.)")
    elif dialect == "recursive":
        body = "".join(_MEANS.get(x) or re.escape(x) for x in _WILD.findall(pattern))
    else:
        raise ValueError(f"no such dialect: {dialect}")
    return rf"\A{body}\z"


def literal_prefix(pattern: str) -> str:
    """What every match begins with; it is pushed to the scan as StartsWith."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def matches(path: Column | str, pattern: str, dialect: str | None = None) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    if not has_glob(pattern):
        return path == pattern
    prefix = literal_prefix(pattern).rpartition("/")[0]
    hit = path.rlike(compile_glob(pattern, dialect))
    return path.startswith(f"{prefix}/") & hit if prefix and "/**" not in pattern else hit


def select(entries: DataFrame, pattern: str, dialect: str | None = None, inverse: bool = False) -> DataFrame:
    """Entries that match a pattern; only if there are none, those below it as a directory. With `inverse`, all others.

    Whether there are any is a scan of its own for one match; its one row is all that meets the entries.
    """
    below = f"{pattern.rstrip('/')}/{'*' if dialect == 'fnmatch' else '**'}"
    hit, under = matches("path", pattern, dialect), matches("path", below, dialect)
    some = entries.where(hit).limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    chosen = F.coalesce(hit | (under & ~F.col("_some")), F.lit(False))
    narrowed = entries if inverse else entries.where(hit | under)
    return narrowed.join(F.broadcast(some)).where(~chosen if inverse else chosen).select(*entries.columns)

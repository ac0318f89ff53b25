"""Sparse profiles: which entries a checkout covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import keys


#: With so many directories a path is compared with each; with more, its ancestors are looked up among them.
PREFIXES = 64


def is_cone(patterns: list[str]) -> bool:
    return not any(c in p for p in patterns for c in "*?[!")


def covers(directories: list[str]) -> Column:
    """Whether a path is within the cone of `directories`: below one, directly in a directory above one, or a top-level file.

    A profile that isn't a cone covers everything: it is better to show too much than to hide files.
    """
    if not is_cone(directories):
        return F.lit(True)
    cone = sorted({d.strip("/") for d in directories if d.strip("/")})
    parents = sorted({"/".join(d.split("/")[:k]) for d in cone for k in range(1, d.count("/") + 1)})
    path = F.col("path")
    hit = ~path.contains("/")
    if parents:
        hit = hit | F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1).isin(*parents)
    if len(cone) <= PREFIXES:
        for directory in cone:
            hit = hit | path.startswith(f"{directory}/")
    else:
        hit = hit | F.arrays_overlap(keys.ancestors(path), F.array(*map(F.lit, cone)))
    return F.coalesce(hit, F.lit(False))


def inside(entries: DataFrame, directories: list[str]) -> DataFrame:
    """Entries that the profile covers."""
    return entries.where(covers(directories))


def partition(entries: DataFrame, directories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries inside the profile, and outside."""
    return inside(entries, directories), entries.where(~covers(directories))


def reachable_shards(directories: list[str]) -> list[str] | None:
    """The shards that a cone touches, top-level files among them; None where any may be."""
    if not is_cone(directories):
        return None
    return sorted({d.strip("/").split("/")[0] for d in directories if d.strip("/")} | {keys.ROOT_SHARD})


def to_remove(previous: DataFrame, current: DataFrame, directories: list[str]) -> DataFrame:
    """Paths to prune: entries that were dropped, and current ones outside the profile."""
    gone = previous.select("path").join(current, "path", "left_anti")
    return gone.union(partition(current, directories)[1].select("path")).distinct()

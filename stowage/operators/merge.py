"""Three-way merges of maps and of ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_maps(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """key, value and conflict of maps (key, value). Values travel in structs, so that a null value isn't an absent one; ours stays where both changed."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", F.struct("value").alias(name))

    rows = side(base, "b").join(side(ours, "o"), "key", "full").join(side(theirs, "t"), "key", "full")
    mine, other = ~F.col("o").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    conflict = mine & other & ~F.col("o").eqNullSafe(F.col("t"))
    kept = F.when(~mine & other, F.col("t")).otherwise(F.col("o"))
    merged = rows.select("key", kept.alias("kept"), conflict.alias("conflict")).where("kept is not null or conflict")
    return merged.select("key", F.col("kept.value").alias("value"), "conflict")


def merge_lists(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """line, part and ord of ordered lists of different lines (line, ord): those of the base that both sides have, in the base's order, then what ours added, then what theirs added."""
    sides = [df.select("line", F.col("ord").cast("long").alias(name)) for df, name in ((base, "b"), (ours, "o"), (theirs, "t"))]
    rows = sides[0].join(sides[1], "line", "full").join(sides[2], "line", "full")
    kept = F.col("b").isNull() | (F.col("o").isNotNull() & F.col("t").isNotNull())
    part = F.when(F.col("b").isNotNull(), 0).when(F.col("o").isNotNull(), 1).otherwise(2)
    return rows.where(kept).select("line", part.alias("part"), F.coalesce("b", "o", "t").alias("ord"))


def key_union(*sides: DataFrame) -> DataFrame:
    """Each key of some maps once."""
    out = sides[0].select("key")
    for side in sides[1:]:
        out = out.union(side.select("key"))
    return out.distinct()


def unknown_keys(settings: DataFrame, known: DataFrame) -> DataFrame:
    """Keys of settings that aren't among the known ones."""
    return settings.select("key").distinct().join(known, "key", "left_anti")


def merge_manifests(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Merge documents (kind, key, value): entries and settings by the same rule, apart from each other."""
    both = [df.select(F.struct("kind", "key").alias("key"), "value") for df in (base, ours, theirs)]
    merged = merge_maps(*both)
    return merged.select("key.kind", "key.key", "value", "conflict")

"""Mixing sources to target weights by a curriculum that changes over time, in DataFrame functions only.

Each source has a weight and a schedule w(t), t from 0 to 1, of how its share changes over training.
The integral of the schedule, scaled to the source's target, is its cumulative demand for words; a
document whose copy begins after u words of its source is due at the t where the demand reaches u.
The mix is the copies range-sorted by that position.

Places in a source are prefix sums in an order given by a hash of the document. They come in two
steps, sums over slices of the hash and then sums within a slice, so that a source with a third of
all rows is spread like any other: no window ever sees more than one slice.

Defined results: null and empty texts have no words and are never taken; a text of any length is one
row; a null source is a source, last in order; rows that share a doc_id, or have none, are documents of
their own and are ordered by their texts; rows equal in id and text may change places, which changes no
result; documents due at the same position go by doc_id; repeated rows count each time; an empty table
gives an empty mix; other columns, whatever their names, pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import Written, words_of

#: Slices of a source's order. A window holds one source's documents of one slice.
SLICES = 4096
#: No document is taken more often.
MOST_COPIES = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's weight at the start and at the end of training, relative to its mean, in turn by its order.
#: Between them it is linear, so the integral up to t is a*t + (b-a)*t*t/2 and has a closed inverse.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def targets(sizes: DataFrame, limit: int = MOST_COPIES) -> DataFrame:
    """Each source's `rank`, `weight` and `target`, from `sizes` (source, source_size): a row for each source.

    Targets share the total by weight; one that passes `limit` times its source's size stops there
    and what is over is shared again among the rest by weight, until none is above. As the shares of
    the others only grow, the sources that stop are the first in order of size/weight: one running
    sum finds them all. Each round of sharing is a prefix in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1).cast("double"))
    whole = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size").cast("double") * limit
    # What is left for this source and those after it, if all before it stop at their limit.
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    weight = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = ranked.withColumns({"_full": full, "_level": rest / weight})
    share = share.withColumn("_stops", F.col("_level") * F.col("weight") > F.col("_full"))
    # The first that doesn't stop sets the level of all after it.
    level = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = share.withColumn("target", F.when(F.col("_stops"), F.col("_full")).otherwise(F.least(level * F.col("weight"), F.col("_full"))))
    return share.select("source", "source_size", "rank", "weight", "target")


def _due(u: Column, rank: Column) -> Column:
    """The t at which the integral of the source's schedule reaches the share u of its whole."""
    out = None
    for k, (a, b) in enumerate(SCHEDULES):
        whole = (a + b) / 2
        t = u if a == b else (F.sqrt(F.greatest(a * a + 2 * (b - a) * u * whole, F.lit(0.0))) - a) / (b - a)
        out = F.when(rank % len(SCHEDULES) == k, t) if out is None else out.when(rank % len(SCHEDULES) == k, t)
    out = out.otherwise(F.lit(None))
    return F.when(out <= 0, 0.0).when(out >= 1, 1.0).otherwise(out)


def plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = (), write: bool = True) -> DataFrame:
    """A row for each row of `docs`: its key, `size`, `source`, `source_size`, `target`, `rank`, `start` (words of its source before it), `copies` and `taken`.

    Copy e of a document covers the words [e*source_size + start, + size) of its source's stream, and
    is taken if its middle is within the target: the sum is within half a document of the target.
    """
    # By id and text, so that rows without an id, or with the same one, are spread as well.
    digits = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).cast("binary"))
    hashed = F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), hashed.alias("_hash"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    narrow = narrow.withColumn("_slice", F.pmod("_hash", F.lit(SLICES)).cast("int"))
    held = Written(narrow, "mix") if write else None
    narrow = held.df if held else narrow
    slices = narrow.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    slices = Written(slices, "mix-slices").df
    shares = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    slices = slices.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    slices = slices.select(F.struct("source").alias("_src"), "_slice", "_before", "source_size", "target", "rank")
    within = Window.partitionBy("_src", "_slice").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # Documents without words are never taken and come nowhere: they stay out of the windows, of which one could else hold them all.
    none = narrow.where("size = 0").join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    none = none.withColumns({"start": F.lit(0).cast("long"), "copies": F.lit(0)})
    placed = narrow.where("size > 0").withColumn("_src", F.struct("source")).withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(slices, ["_src", "_slice"])
    start = F.col("_before") + F.col("_in")
    middle = start + F.col("size") / 2
    copies = F.lit(0)
    for e in range(MOST_COPIES):
        copies = copies + F.when((F.col("size") > 0) & (middle + e * F.col("source_size") <= F.col("target")), 1).otherwise(0)
    placed = placed.withColumns({"start": start, "copies": copies})
    names = ["doc_id", "size", "source", "source_size", "target", "rank", "start", "copies", *[f"_keep_{c}" for c in keep]]
    return placed.select(*names).unionByName(none.select(*names)).withColumn("taken", F.col("copies") * F.col("size"))


def position(start: Column, copy: Column, source_size: Column, target: Column, rank: Column) -> Column:
    """The training position, from 0 to 1, of a copy."""
    return _due(F.least((copy * source_size + start) / F.greatest(target, F.lit(1e-9)), F.lit(1.0)), rank)


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: a row of `docs` for each copy taken, in order of training position."""
    columns = docs.columns
    rows = plan(docs, keep=tuple(columns), write=False).where(F.col("copies") > 0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("_position", position(F.col("start"), F.col("_copy"), F.col("source_size"), F.col("target"), F.col("rank")))
    return rows.orderBy("_position", "doc_id").select(*[F.col(f"_keep_{c}").alias(c) for c in columns])


def mix_table(docs: DataFrame) -> DataFrame:
    """The digest columns, a row for each of `docs`, sorted by the training position of its first copy (not taken: null)."""
    rows = plan(docs.select("doc_id", "text", "source"))
    first = position(F.col("start"), F.lit(0), F.col("source_size"), F.col("target"), F.col("rank"))
    rows = rows.withColumn("position", F.when(F.col("copies") > 0, first))
    return rows.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "position")

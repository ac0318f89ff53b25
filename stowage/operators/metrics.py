"""Metrics of pipeline stages from a timeline of workers and from task durations."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Slices of time that a stage is cut into: no window holds more than one of them.
SLICES = 1024


def _sliced(rows: DataFrame) -> DataFrame:
    """`rows` with the slice of its stage's time that each is in."""
    spans = rows.groupBy("stage").agg(F.min("ts").alias("_from"), ((F.max("ts") - F.min("ts")) / SLICES).alias("_step"))
    at = F.when(F.col("_step") > 0, F.least(F.floor((F.col("ts") - F.col("_from")) / F.col("_step")), F.lit(SLICES - 1))).otherwise(0)
    return rows.join(spans, "stage").withColumn("_slice", at.cast("int")).drop("_from", "_step")


def active_workers(events: DataFrame) -> DataFrame:
    """stage, ts, seq and workers after each start (+1) or end (-1), from (stage, ts, seq, delta): the sum of the slices before, and a running sum within the slice."""
    rows = _sliced(events.select("stage", "ts", "seq", "delta"))
    sums = rows.groupBy("stage", "_slice").agg(F.sum("delta").alias("_sum"))
    before = Window.partitionBy("stage").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stage", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("stage", "_slice").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum("delta").over(within)).join(sums, ["stage", "_slice"]).select("stage", "ts", "seq", (F.col("_before") + F.col("_in")).alias("workers"))


def peak_workers(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("stage").agg(F.max("workers").alias("peak"))


def parallelism(timeline: DataFrame) -> DataFrame:
    """stage, area (workers times duration; the last point has none) and span, from (stage, ts, seq, workers), in the unit of ts."""
    rows = _sliced(timeline.select("stage", "ts", "seq", "workers"))
    starts = rows.groupBy("stage", "_slice").agg(F.min("ts").alias("_start"))
    starts = starts.select("stage", "_slice", F.lead("_start").over(Window.partitionBy("stage").orderBy("_slice")).alias("_next"))
    # A slice's last point lasts until the first of the next one that has any.
    within = Window.partitionBy("stage", "_slice").orderBy("ts", "seq")
    rows = rows.withColumn("_lead", F.lead("ts").over(within)).join(starts, ["stage", "_slice"])
    step = F.col("workers") * (F.coalesce("_lead", "_next") - F.col("ts"))
    return rows.groupBy("stage").agg(F.coalesce(F.sum(step), F.lit(0)).alias("area"), (F.max("ts") - F.min("ts")).alias("span"))


def average_parallelism(areas: DataFrame) -> DataFrame:
    return areas.withColumn("average", F.when(F.col("span") > 0, F.col("area") / F.col("span")).otherwise(0.0))


def utilisation(areas: DataFrame, workers: DataFrame) -> DataFrame:
    """Average parallelism by the most workers (stage, max_workers); zero without any."""
    rows = average_parallelism(areas).join(workers, "stage")
    return rows.withColumn("utilisation", F.when(F.col("max_workers") > 0, F.col("average") / F.col("max_workers")).otherwise(0.0))


def durations(tasks: DataFrame) -> DataFrame:
    """stage, tasks, and the mean, least and greatest duration (stage, duration); zero without tasks."""
    return tasks.groupBy("stage").agg(
        F.count("duration").alias("tasks"),
        *[F.coalesce(f("duration"), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "greatest"))],
    )


def stage_spans(stages: DataFrame) -> DataFrame:
    """stage and seconds from (stage, start, end); null where either is missing or zero."""
    known = (F.coalesce("start", F.lit(0.0)) != 0) & (F.coalesce("end", F.lit(0.0)) != 0)
    return stages.select("stage", F.when(known, F.col("end") - F.col("start")).alias("seconds"))


class Tracker:
    """Collects the timeline of a pipeline on the driver, as rows for the operators above."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.events: list[tuple[str, float, int, int]] = []
        self.tasks: list[tuple[str, float]] = []
        self.stages: dict[str, list[float | None]] = {}

    def start_stage(self, stage: str) -> None:
        self.stages[stage] = [time.time(), None]

    def end_stage(self, stage: str) -> None:
        self.stages[stage][1] = time.time()

    @contextmanager
    def track(self, stage: str):
        began = time.time()
        self.events.append((stage, began, len(self.events), 1))
        try:
            yield
        finally:
            ended = time.time()
            self.events.append((stage, ended, len(self.events), -1))
            self.tasks.append((stage, ended - began))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """events, tasks and stages."""
        return (
            spark.createDataFrame(self.events, "stage string, ts double, seq long, delta int"),
            spark.createDataFrame(self.tasks, "stage string, duration double"),
            spark.createDataFrame([(k, *v) for k, v in self.stages.items()], "stage string, start double, end double"),
        )

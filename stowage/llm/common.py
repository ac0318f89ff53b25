"""What the operators of this folder share: the shared folder, tables written to it, small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import ship

#: The six ASCII white-space characters that end a word: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: One or more of them, as a Java regular expression.
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: A table is written by no more tasks than there are so many bytes in the files that it is made from, or than so many for each core, whichever is more.
TASK_BYTES, TASKS_A_CORE = 1 << 20, 4
#: Paths of the tables that Written has made and not dropped.
_PATHS: list[str] = []
#: Shuffle files are dropped as soon as the statement that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that go to a Python worker at once: texts are long, and each is held several times over.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder of this machine for a local master, and an error for a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stowage-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stowage-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder. Results must have been written elsewhere by then."""
    drop_path(spark, _own_folder(spark))
    _PATHS.clear()


def drop_since(spark: SparkSession, mark: int, kept: DataFrame) -> None:
    """Delete the tables that were written after the first `mark` ones, but for those that `kept` reads. Nothing else may read them any more."""
    bare = lambda path: re.sub(r"^[A-Za-z][\w+.-]*:(?://[^/]*)?", "", path)
    reads = {bare(f).rpartition("/")[0] for f in kept.inputFiles()}
    for path in _PATHS[mark:]:
        if bare(path) not in reads:
            _PATHS.remove(path)
            drop_path(spark, path)


def tables_written() -> int:
    """How many tables this process has written and not dropped: a mark for drop_since()."""
    return len(_PATHS)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, send them small batches, and let Spark drop a statement's shuffle files at its end rather than when the driver collects garbage.

    The settings stay with the session: results are lazy and run after the operator has returned.
    """
    spark.conf.set(_CLEANUP, "true")
    for name, value in _BATCHES.items():
        spark.conf.set(name, value)
    ship(spark)


class Written:
    """A DataFrame cut from its lineage: written once to the shared folder and read from there.

    Each task of the last stage writes a file. How many there are is for Spark to say, from the sizes of
    scans and shuffles, as long as what is read has TASK_BYTES for each of them: with more tasks than that,
    one takes several partitions. The larger the input, the less that binds.
    """

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        _PATHS.append(self.path)
        schema = df.schema
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        read = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
        df = df.coalesce(min(max(TASKS_A_CORE * self.spark.sparkContext.defaultParallelism, read // TASK_BYTES), (1 << 31) - 1))
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        if self.path in _PATHS:
            _PATHS.remove(self.path)
        drop_path(self.spark, self.path)


def words_of(text: Column) -> Column:
    """The words of a text: its longest runs of other characters than BLANKS; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def as_list(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows of a small, bounded DataFrame on the driver."""
    return [tuple(r) for r in df.select(*columns).collect()]

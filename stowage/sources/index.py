"""The paths that a version-control index holds."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """path of every file in the git index of `root`; none where there is no index. Names are bytes, so that odd ones stay as they are."""
    try:
        found = subprocess.run(["git", "ls-files", "-z"], capture_output=True, cwd=root, check=False)
    except FileNotFoundError:  # no git here
        return spark.createDataFrame([], "path string")
    names = found.stdout.decode("utf-8", "surrogateescape").split("\0") if found.returncode == 0 else []
    return spark.createDataFrame([(n.encode("utf-8", "replace").decode(),) for n in names if n], "path string")

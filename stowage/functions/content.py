"""Functions over file contents: digests, chunks, compression."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

#: A file is compressed if the first SAMPLE bytes shrink below WORTH of their size.
SAMPLE, WORTH = 256 * 1024, 0.9


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def is_chunked(size: Column, chunk_size: int) -> Column:
    """Whether a file is stored in chunks."""
    return size > chunk_size


def n_chunks(size: Column, chunk_size: int) -> Column:
    """Chunks hold one byte less than the chunk size; an empty file has none."""
    return F.ceil(size / (chunk_size - 1)).cast("int")


def split(content: Column, chunk_size: int) -> Column:
    """The chunks of a file, in order: an array of (chunk_index, content)."""
    content, step = content.cast("binary"), chunk_size - 1
    count = n_chunks(F.octet_length(content), chunk_size)
    chunk = lambda k: F.struct(k.alias("chunk_index"), F.substring(content, k * step + 1, F.lit(step)).alias("content"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), chunk)).otherwise(F.array().cast("array<struct<chunk_index:int,content:binary>>"))


@F.pandas_udf(BinaryType())
def gzip_compress(content: pd.Series) -> pd.Series:
    """Gzip without name and time, so that equal contents give equal bytes."""
    return content.map(lambda x: None if x is None else gzip.compress(bytes(x), 5, mtime=0))


@F.pandas_udf(BinaryType())
def gzip_decompress(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else gzip.decompress(bytes(x)))


@F.pandas_udf(BooleanType())
def _shrinks(sample: pd.Series) -> pd.Series:
    return sample.map(lambda x: bool(x) and len(gzip.compress(bytes(x), 1)) < WORTH * len(x))


def should_compress(content: Column, mode: str = "auto") -> Column:
    """Whether a file is stored compressed."""
    if mode in ("always", "never"):
        return F.lit(mode == "always")
    return _shrinks(F.substring(content.cast("binary"), 1, SAMPLE))


def is_lfs_pointer(content: Column) -> Column:
    """Whether a file is a pointer of Git LFS rather than its content, by its first bytes."""
    return F.substring(content.cast("binary"), 1, 512).cast("string").startswith("version https://git-lfs.github.com/spec/v1")

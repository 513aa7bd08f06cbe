"""What several operators share: word rules, row keys, shared folders."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.documents import shared_folder

#: The ASCII white space that parts words.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``uid, doc_id, text`` and the named columns: one row for each input row; null texts become empty.

    ``uid`` tells apart rows that share an id (or have none). It holds within one plan only: never join two reads on it.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more).withColumn("uid", F.monotonically_increasing_id())


def words_of(text: Column) -> Column:
    """The runs of characters that are not ASCII white space, in order."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RE))


def crc_of(id_column: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit)))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Hands what is free in this Python worker back to the system; workers live on from stage to stage, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


class _Made(threading.local):
    """The folders that this thread has written: jobs that run at once in one driver don't see each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. The folder stays until ``clear``, or the driver's orderly end."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    _made.paths.append(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many folders this thread has written so far."""
    return len(_made.paths)


def clear(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the folders written since a mark but for the last ones; what still reads them must be done."""
    for path in _made.paths[since : len(_made.paths) - keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _made.paths[since : len(_made.paths) - keep]

"""How batches and packed rows travel between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, settle

__all__ = ["deal", "discard", "frugal", "lean_batches", "settle", "small_side", "tasks"]

#: Bytes from which a worker's arrays are mapped apart, so that freed ones go back to the machine at once.
MAPPED = 4 << 20


#: Rows and bytes of batches of texts between Spark and Python, and rows of those that are read from Parquet, where the session has Spark's own 10000, 64 MB and 4096: such batches, for each task and on all sides, are most of what an executor has beside its tables, and large arrays leave its heap in pieces.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"),
}


def lean_batches(spark: SparkSession) -> None:
    """Lets batches of texts be small; it changes no result."""
    for name, (usual, lean) in BATCH.items():
        if spark.conf.get(name) == usual:  # without a default, which would hide what Spark has
            spark.conf.set(name, lean)


@functools.cache
def _trim() -> Callable:
    """Sets the allocator of this process up, once, and returns what gives its free memory back; neither can be had everywhere."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        return functools.partial(libc.malloc_trim, 0)
    except (OSError, AttributeError):
        return lambda: None


def frugal(run: Callable) -> Callable:
    """A function from batches to batches whose worker holds no free memory when it is done, as workers stay for later tasks."""

    @functools.wraps(run)
    def trimmed(batches):
        trim = _trim()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim()

    return trimmed


def tasks(spark: SparkSession) -> int:
    """Partitions of an exchange of packed rows: the session's shuffle partitions, set in proportion to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal(df: DataFrame, n: int) -> DataFrame:
    """Row to task by its column `part`, exactly."""
    return df.repartitionById(n, F.col("part"))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it is counted to have at most so many rows; df must be settled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

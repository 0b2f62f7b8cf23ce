"""Scratch tables in the shared folder and small helpers of the operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultlens.session import SHUFFLE_CLEANUP, discard, ship_package, shuffles_dropped, unique_dir     # noqa: F401


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package importable on the executors."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table read back, and its path.

    Cuts the lineage: later jobs read files that outlive any executor.
    """
    spark = df.sparkSession
    path = unique_dir(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """Return a worker's free memory to the system; workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # not glibc: nothing to trim
        pass


def tidy(run: Callable[..., Iterator], *after: Callable[[], None]) -> Callable[..., Iterator]:
    """``run`` for ``mapInArrow``; ``after`` and :func:`give_back` follow at the task's end."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in after:
                f()
            give_back()

    return wrapped

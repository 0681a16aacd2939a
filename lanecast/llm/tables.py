"""Reading the text tables and writing intermediate tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import freeze

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table by Spark's own reader, so the folder may be in any store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package.

    On a cluster the package is installed, or shipped with ``--py-files``; a
    local session may run from another working directory.
    """
    if spark.sparkContext.master.startswith("local"):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in paths.split(os.pathsep):
            joined = os.pathsep.join(filter(None, [ROOT, paths]))
            spark.sparkContext.environment["PYTHONPATH"] = joined


def release_memory() -> None:
    """Give what a Python worker no longer uses back to the system.

    Workers are reused from stage to stage; what allocators keep of one stage would
    count against the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run):
    """``run``, a function of batches, that gives memory back when its task ends."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def texts_of(column: pa.Array, rows: int = 1000) -> Iterator[str]:
    """The column's texts, null as empty; few of them are copied out of the batch at a time."""
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).to_pylist():
            yield text or ""


def dealt_evenly(df: DataFrame, rows_per_task: int) -> DataFrame:
    """A written table in enough tasks for rows that expand; counting it reads only footers."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(tasks)


__all__ = ["dealt_evenly", "freeze", "importable", "release_memory", "releasing", "table", "texts_of"]

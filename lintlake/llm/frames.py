"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.session import materialise

#: An id that is absent sorts after every id.
NO_ID = (1 << 63) - 1


def row_key() -> Column:
    """Equal for rows with the same doc_id and text only, up to collisions of 64-bit hashes within one doc_id."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


stash = materialise


def give_back() -> None:
    """Return this process's free memory to the system. Only a hint; a C library that lacks the call keeps what it has."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows`` (batches to batches), after whose end the worker gives back its free memory: it stays for other operators' tasks."""

    @functools.wraps(rows)
    def run(batches):
        yield from rows(batches)
        give_back()

    return run


def release(spark: SparkSession) -> None:
    """Let the driver's JVM notice that finished steps are unreachable, so that Spark's cleaner deletes their shuffle files now and not
    whenever the driver next runs short of memory. Only a hint; results do not depend on it."""
    for _ in range(2):  # what the first round frees holds on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)

"""Memory beside the heap: workers live on after a task, and rows of whole texts go to them in batches of bounded rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession


def give_back() -> None:
    """Free memory that the allocators still hold goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives its memory back after its last batch."""

    @wraps(run)
    def inside(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inside


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1000  # rows with whole texts that are in one batch


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand at most ``TEXTS`` rows at a time to Python; the session's setting comes back afterwards."""
    before = spark.conf.get(ROWS, None)
    if before is None or not 0 < int(before) <= TEXTS:
        spark.conf.set(ROWS, str(TEXTS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROWS)
        else:
            spark.conf.set(ROWS, before)

"""Size of the Arrow batches that Python workers get, and what workers keep between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts of 20,000 words have over 100 KB; so many of them are still only tens of MB, in the worker and off the JVM's heap.
ROWS = 512


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Hold batches to ``rows`` rows, unless the session asks for fewer."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What modules remember in this process, by the module whose tasks use it.
_remembered: dict[str, list[dict]] = {}


def remember(module: str, cache: dict) -> None:
    """``cache`` is kept from task to task of ``module``, until tasks of another one run in the same worker."""
    _remembered.setdefault(module, []).append(cache)


def forget_others(module: str) -> None:
    for name, caches in _remembered.items():
        for cache in caches if name != module else ():
            cache.clear()


@functools.cache
def _trimmer() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        return None


def trim() -> None:
    """Free memory that the allocators hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trimmer() is not None:
        _trimmer()(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for workers that stay and are used by one operator after another: before it begins, what other modules
    remember goes, and at its end free memory does."""
    module = run.__module__

    def leaner(batches):
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            trim()

    return leaner

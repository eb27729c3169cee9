"""Cutting lineage through the folder that all executors share, and letting go of what was kept on the way.

The folder is the one the session names in ``spark.checkpoint.dir``; a folder of our own is set only where none is
named and the session runs in one process (tests and notebooks in local mode).
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Spooled tables that go when the process ends.
_spooled: list[tuple[DataFrame, str]] = []
#: (table, its path or None if held) of the innermost open ``scratch`` block.
_open: ContextVar[list[tuple[DataFrame, str | None]] | None] = ContextVar("_open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one as checkpoint folder where a local session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/tessella")
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: for small iterated tables (labels, frontiers)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a file, where the number of rows is known.
FILE_ROWS = 100_000


def hold(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks for several uses; what a lost executor held is computed again. For tables
    that are wide, or have many partitions, and need no cut of their lineage."""
    return _noted(df.persist(StorageLevel.DISK_ONLY), None)


def spool(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: columnar, compressed, free of lineage.

    Unlike a checkpoint the result is pruned by column and filtered in the scan. Where ``rows``, a bound of its rows,
    is known, it is written by so many tasks that each has ``each`` of them: a table of a few rows that comes out of a
    wide shuffle shouldn't become hundreds of files.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/spool-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return _noted(df.sparkSession.read.schema(schema).parquet(path), path)


def _noted(df: DataFrame, path: str | None) -> DataFrame:
    mine = _open.get()
    if mine is not None:
        mine.append((df, path))
    elif path is not None:
        _spooled.append((df, path))
    return df


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Whatever is held or spooled within the block goes at its end, but for tables that were passed to the function
    that the block gets: those belong to the block around it. What leaves the block may only be made of these."""
    outer, mine, kept = _open.get(), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _open.set(mine)
    try:
        yield keep
    finally:
        _open.reset(token)
        for df, path in mine:
            if not any(df is k for k in kept):
                _drop(df, path)
            elif outer is not None:
                outer.append((df, path))
            elif path is not None:
                _spooled.append((df, path))


def drop(df: DataFrame) -> None:
    """Let go of a table that was held or spooled before its block, or the process, ends."""
    for noted in (_open.get() or [], _spooled):
        for i, (own, path) in enumerate(noted):
            if own is df:
                del noted[i]
                _drop(df, path)
                return


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within the block the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
    For chains of queries that each write their result."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def _drop(df: DataFrame, path: str | None) -> None:
    if path is None:
        df.unpersist()
        return
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_spooled() -> None:
    for df, path in _spooled:
        try:
            _drop(df, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner cleans up then
            return

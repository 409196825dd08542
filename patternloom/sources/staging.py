"""Tables that several steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_live: dict[str, SparkSession] = {}  # tables that are not yet deleted


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode and where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="patternloom-"))
    return _own[0]


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """The write's shuffle files are removed as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table and read it from there. Later plans are short, do not copy its expressions into every filter and
    key, and lose nothing with an executor. The table is deleted by :func:`drop_stage`, at the end of a
    :func:`finished` around it, or when the process ends, whichever is first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = spark
    with _shuffle_files_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def spool(spark: SparkSession, source: BinaryIO, size: int = 1 << 20) -> str:
    """Copy a stream of bytes to a file in the shared folder, ``size`` bytes at a time; its path."""
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    _live[path] = spark
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file)
    try:
        while block := source.read(size):
            out.write(block)
    finally:
        out.close()
    return path


def _delete(path: str) -> None:
    spark = _live.pop(path, None)
    if spark is not None:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop_stage(*tables: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote and nothing reads any more."""
    for t in tables:
        _delete(t._stage_path)


@contextmanager
def collecting(tables: list[str]):
    """Within it, the paths of staged tables are added to ``tables``."""
    before = set(_live)
    try:
        yield
    finally:
        tables += set(_live) - before


def drop_paths(tables: list[str]) -> None:
    """Delete what was collected."""
    while tables:
        _delete(tables.pop())


def finished(make: Callable[[], DataFrame], name: str, *inputs: DataFrame) -> DataFrame:
    """Stage what ``make`` returns, then delete what was staged for it, and ``inputs``."""
    before = set(_live) - {t.__dict__.get("_stage_path") for t in inputs}
    out = stage(make(), name)
    for path in set(_live) - before - {out._stage_path}:
        _delete(path)
    return out


def partitions_for(df: DataFrame, size: int = 128 << 20) -> int:
    """Partitions for a sort of ``df``: the session's number, or more where the planner's estimate of its size asks for more."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, int(str(estimate)) // size))


def sized(table: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A staged table as the smaller side of a join: broadcast where its rows, unpacked, take ``most`` bytes at the
    most, else joined by shuffle (a packed file's size tells little about that)."""
    width = {"string": lambda c: F.coalesce(F.octet_length(c), F.lit(0)) + 24}
    row = sum((width.get(t, lambda c: F.lit(16))(F.col(c)) for c, t in table.dtypes), F.lit(32))
    total = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if total <= most else table.hint("merge")


@atexit.register
def _at_the_end() -> None:
    for path in list(_live):
        try:
            _delete(path)
        except Exception:  # the session has ended already
            return

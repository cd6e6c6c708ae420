"""Intermediate tables of the text operators, deleted as soon as what they were made for is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from hourweave.session import scratch_path

#: Folders of the innermost ``settled`` that is being worked on.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``session.written`` for a table that goes when the ``settled`` around it has its result."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (folders := _open.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written; every table that ``build`` wrote meanwhile is deleted afterwards.

    The result then depends on its own files alone, so a lost executor never asks for a deleted table. If ``build`` or
    the writing fails, the tables go as well.
    """
    folders: list[str] = []
    mark = _open.set(folders)
    spark = None
    try:
        result = build()
        spark = result.sparkSession
        # the result belongs to the block around this one
        _open.reset(mark)
        mark = None
        return written(result, name)
    finally:
        if mark is not None:
            _open.reset(mark)
        delete(spark or SparkSession.getActiveSession(), folders)


def delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when their job is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)

"""The folder all executors share for files written on the way."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_book: ContextVar[list[str] | None] = ContextVar("staged paths", default=None)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset.

    Both are shared by driver and executors on a cluster, unlike a machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet to the shared scratch folder and read it from there.

    A score scans its table several times.  For a database query, a CSV file or a long plan
    that would repeat the whole read each time; a staged copy also stays the same meanwhile.
    """
    path = scratch_dir(df.sparkSession, "staged")
    if (book := _book.get()) is not None:
        book.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def booked() -> Iterator[list[str]]:
    """The paths of all tables that are staged inside, for :func:`give_back`."""
    paths: list[str] = []
    token = _book.set(paths)
    try:
        yield paths
    finally:
        _book.reset(token)
        if (outer := _book.get()) is not None:
            outer.extend(paths)


def give_back(spark: SparkSession, paths: Iterable[str]) -> None:
    """Free the space of staged tables that nothing reads any more.

    Each is written over with an empty table, which Spark does on any file system it can write to.
    """
    paths = list(paths)
    if not paths:
        return
    empty = spark.createDataFrame([], "nothing int").coalesce(1)
    for path in paths:
        empty.write.mode("overwrite").parquet(path)

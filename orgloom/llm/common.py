"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Open scopes of this thread, the innermost last; each lists the paths that go when it ends.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a local session, as in tests, makes one; any
    other raises, as executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="orgloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/orgloom/{name}-{uuid.uuid4().hex[:12]}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the session's file systems find it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside go at the end; what must outlive the scope is stored by ``kept``."""
    paths: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for path in paths:
            removed(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def outside() -> Iterator[None]:
    """Folders that are made inside belong to the scope around the present one."""
    before = _SCOPES.set(_SCOPES.get()[:-1])
    try:
        yield
    finally:
        _SCOPES.reset(before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Stored as a table of the scope around the present one."""
    with outside():
        return stored(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those whose 64-bit hash ``key`` is smallest; hardly more than these are sorted."""
    total = df.count()
    if total > 2 * n:
        df = df.filter(F.col(key) < int(-(1 << 63) + (1 << 64) * 1.2 * n / total))
    return df.orderBy(key).limit(n)


def sliced(column: pa.Array, rows: int = 500) -> Iterator[list]:
    """A column's values, few rows at a time, so that a worker never holds a whole batch as objects."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def slices(batch: pa.RecordBatch, text_column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have at most so many bytes, or are single."""
    sizes = np.cumsum(pc.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to

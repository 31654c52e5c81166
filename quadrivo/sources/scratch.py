"""Intermediate tables, written where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Paths that the scratch block around the current code has given out, by thread or task.
_given: ContextVar[list[str] | None] = ContextVar("quadrivo_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or, where that is unset,
    a temporary folder in local mode and a folder of the warehouse on a cluster, which must not be a local one."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not hasattr(context, "_quadrivo_shared"):
        if context.master.startswith("local[") or context.master == "local":
            where = f"file://{tempfile.mkdtemp(prefix='quadrivo-')}"
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_quadrivo"
            if _file_system(spark, where)[1].getUri().getScheme() == "file":
                raise RuntimeError(f"executors can't share {where}: set spark.checkpoint.dir to a folder that all of them reach")
        context._quadrivo_shared = where
    return context._quadrivo_shared


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _session_dir(spark: SparkSession) -> str:
    """A folder of this Spark context in the shared folder. It is removed when the context's JVM ends."""
    context = spark.sparkContext
    if not hasattr(context, "_quadrivo_dir"):
        path = f"{shared_dir(spark)}/quadrivo-{uuid.uuid4().hex}"
        where, store = _file_system(spark, path)
        store.mkdirs(where)
        store.deleteOnExit(where)
        context._quadrivo_dir = path
    return context._quadrivo_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    given = _given.get()
    if given is not None:
        given.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to new paths inside, by the same thread, is removed at the end, by when nothing may need it any more."""
    paths: list[str] = []
    token = _given.set(paths)
    try:
        yield
    finally:
        _given.reset(token)
        for path in paths:
            drop_path(spark, path)


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, as Python workers reach it, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def drop_path(spark: SparkSession, path: str) -> None:
    where, store = _file_system(spark, path)
    store.delete(where, True)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

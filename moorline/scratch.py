"""Folders for intermediate tables, on storage that the driver and all executors share.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, and go when the driver
ends, or earlier with `clear_scratch`. Only a session that runs in one process (tests) may leave
that setting out.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_SCRATCH: dict[str, list[str]] = {}
_PASSING = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends.

    Where that is unset, a session with executors of its own is refused: they would not see each
    other's files. A session within one process gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="moorline-"))
        base = f"file://{_OWN_FOLDER[0]}"
    folder = f"{base.rstrip('/')}/moorline-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(folder)
    if getattr(_PASSING, "folders", None) is not None:
        _PASSING.folders.append(folder)
    return folder


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete behind the block what this thread stored in it: a stream's batches leave nothing behind."""
    before, _PASSING.folders = getattr(_PASSING, "folders", None), []
    try:
        yield
    finally:
        mine, _PASSING.folders = _PASSING.folders, before
        known = _SCRATCH.get(spark.sparkContext.applicationId, [])
        for folder in mine:
            discard(spark, folder)
            if folder in known:
                known.remove(folder)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and Spark drops
    the shuffle files that led to it."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    schema = df.schema
    with setting(spark, CLEANUP, "true"):
        df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what all operators of this application wrote so far; results not yet read are lost."""
    for folder in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        discard(spark, folder)

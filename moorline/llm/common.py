"""Shared-folder tables and small helpers of the training-data operators.

Executors come and go, so whatever cuts lineage is a table in a shared folder (`moorline.scratch`);
tables that no later step reads are deleted on the way.
"""

from __future__ import annotations

import ctypes
import re
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline.scratch import discard, shared_folder, stored

__all__ = ["discard", "shared_folder", "stored"]


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a file or folder, for tasks that read or write files of their own."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def unused(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as no column of `taken` (in any case) has.

    Operators that carry the caller's columns name their own ones this way: nothing is overwritten.
    """
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: Spark's Arrow functions bear no dots in names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def own(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_ids(df: DataFrame, column: str) -> None:
    """Refuse ids that are not whole numbers, before any row is read."""
    kind = df.select(own(column)).schema.fields[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")


def comparable(df: DataFrame) -> list[Column]:
    """A column for each of df's that can be hashed and sorted: maps and variants as JSON."""

    def odd(kind: T.DataType) -> bool:
        if isinstance(kind, (T.MapType, T.VariantType)):
            return True
        return any(odd(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.ArrayType) and odd(kind.elementType)

    return [F.to_json(F.struct(own(f.name).alias("c"))) if odd(f.dataType) else own(f.name) for f in df.schema.fields]


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle is dealt to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one have about `most` bytes (one row at least, `rows` at most)."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.maximum(np.cumsum(lengths, dtype=np.int64) // most, 0) + np.arange(batch.num_rows) // rows
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Trimmer:
    """Gives freed memory back to the system now and then: the C library keeps it otherwise, and an
    executor has several Python workers side by side."""

    def __init__(self, every: float = 0.3):
        self.every, self.last = every, time.monotonic()
        try:
            self.libc = ctypes.CDLL("libc.so.6")
            self.libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: arrays of over 256 KB are returned when freed
        except (OSError, AttributeError):  # another C library has its own ways
            self.libc = None

    def __call__(self) -> None:
        if self.libc is not None and time.monotonic() - self.last > self.every:
            pa.default_memory_pool().release_unused()
            self.libc.malloc_trim(0)
            self.last = time.monotonic()


def letters_lower(column):
    """Lower-case A-Z only, as the contracts say."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

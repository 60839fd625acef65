"""Token-id files: one concatenated id array a file, with Elias-Fano coded document boundaries.

A file holds a run of documents in ascending doc_id order. Its boundaries (n + 1 ids before each
document) are coded in about 2 + log2(ids / documents) bits each: the low bits packed, the high
bits in unary, with a sample of every 64th one, so that select reads one short stretch for one
boundary or a run of them, and no 64-bit table is kept. Writers put each file under a name of its own attempt and hand its name to a
manifest table; only files in the manifest count, so lost or repeated tasks leave no trace.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorline.llm import word_bpe
from moorline.llm.common import opened, shared_folder, stored, width

MAGIC = b"MLTOK001"
FILE_IDS = 2 << 20  # a file is closed once it has so many ids
SAMPLE = 64


class EliasFano:
    """Non-decreasing numbers 0..universe; `select(i)` gives the i-th."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.high, self.samples = n, universe, low, high, samples
        self.width = self.low_width(n, universe)

    @staticmethod
    def low_width(n: int, universe: int) -> int:
        return max(0, (universe // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, universe = len(values), int(values[-1]) if len(values) else 0
        w = cls.low_width(n, universe)
        bits = (values[:, None] >> np.arange(w)[None, :] & 1).astype(np.uint8) if w else np.zeros((n, 0), np.uint8)
        ones = (values >> w) + np.arange(n)
        high = np.zeros((universe >> w) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, universe, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        return int(self.select_run(i, i + 1)[0])

    def select_run(self, a: int, b: int) -> np.ndarray:
        """Numbers a..b-1: the ones between two samples are counted, the low bits cut out beside them."""
        if not 0 <= a < b <= self.n:
            raise IndexError(a, b)
        from_one, last = a // SAMPLE, -(-b // SAMPLE)
        byte = int(self.samples[from_one]) >> 3
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + 8 * byte
        skipped = int(np.searchsorted(ones, int(self.samples[from_one]))) - from_one * SAMPLE
        high = ones[a + skipped : b + skipped] - np.arange(a, b)
        if not self.width:
            return high
        first = a * self.width
        bits = np.unpackbits(self.low[first >> 3 : (b * self.width + 7) >> 3], bitorder="little")[first & 7 :][: (b - a) * self.width]
        return high << self.width | bits.reshape(b - a, self.width).astype(np.int64) @ (1 << np.arange(self.width))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.universe, len(self.low), len(self.high), len(self.samples)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, low, high, samples = np.frombuffer(data, "<u8", 5, at).tolist()
        at += 40
        out = cls(n, universe, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", samples, at + low + high))
        return out, at + low + high + 4 * samples


def file_bytes(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """magic | id width | boundaries | doc_id null bits | doc_ids | id array | crc32 of all before."""
    ends = np.cumsum([0, *(len(d) // 4 for d in documents)])
    ids = np.frombuffer(b"".join(documents), "<u4")
    kind = np.dtype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool))
    body = b"".join([MAGIC, bytes([kind.itemsize]), EliasFano.encode(ends).to_bytes(), nulls.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), ids.astype(kind).tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little")


class TokenFile:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole token file")
        self.bounds, at = EliasFano.from_bytes(data, 9)
        n = self.bounds.n - 1
        self.nulls = np.frombuffer(data, np.uint8, -(-n // 8), at)
        at += -(-n // 8)
        self.numbers = np.frombuffer(data, "<i8", n, at)
        self.ids = np.frombuffer(data, f"<u{data[8]}", self.bounds.universe, at + 8 * n)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def names(self, a: int, b: int) -> list[int | None]:
        """The doc_ids of documents a..b-1."""
        null = np.unpackbits(self.nulls[a >> 3 : (b + 7) >> 3])[a & 7 :]
        return [None if x else d for x, d in zip(null.tolist(), self.numbers[a:b].tolist())]

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds.select_run(i, i + 2).tolist()
        return self.ids[start:end]


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Write all documents in ascending doc_id order (null ids first, a null text as an empty one).

    Returns the folder and its manifest (part, file, path, n_docs, n_ids). Documents of one doc_id
    stay side by side, in order of the texts' hashes. Only these two columns are written, whatever
    others docs has. Without `folder` the files are deleted when the driver ends. An empty table gives no files and an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The hash spreads the rows of one doc_id, or of none, over ranges of their own.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(4 * width(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(f"{base}/ids", recursive=True)
        part, number, doc_ids, documents, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            path = f"ids/{part:06d}-{number:05d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{base}/{path}") as f:
                f.write(file_bytes(doc_ids, documents))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "path": [path], "n_docs": [len(doc_ids)], "n_ids": [held]})

        for names, encoded in word_bpe.encoded(batches, tokenizer, end_id):
            for d, ids in zip(names.to_pylist(), encoded):
                doc_ids.append(d)
                documents.append(ids)
                held += len(ids) // 4
                if held >= file_ids:
                    yield close()
                    number, doc_ids, documents, held = number + 1, [], [], 0
        if doc_ids:
            yield close()

    return folder, stored(ordered.mapInArrow(run, "part int, file int, path string, n_docs long, n_ids long"), folder, "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids binary as little-endian unsigned 32-bit) of all files, from the files."""
    # One row a part for the sums over parts; then sums over the files within each part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("within", within).join(earlier, "part").select("path", (F.col("base") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    file = TokenFile(f.read())
                for a in range(0, len(file), 512):
                    b = min(a + 512, len(file))
                    bounds = file.bounds.select_run(a, b + 1)
                    ids = [file.ids[x:y].astype("<u4").tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(file.names(a, b), pa.int64()), pa.array(first + bounds[:-1]), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return files.repartition(4 * width(spark), "path").mapInArrow(run, "doc_id long, start long, ids binary")

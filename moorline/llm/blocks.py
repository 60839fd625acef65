"""Documents in blocks: row groups in the shared folder that several passes visit without moving texts.

A pass over all texts runs a Python function over whole blocks. What two passes have to tell each
other (hashes out, answers back) travels as packed arrays keyed by bucket or by block, so a shuffle
moves a few bytes a token instead of rows, and texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import Trimmer, opened, sized, stored, width

BLOCK_ROWS = 20_000  # most documents of a block
BLOCK_BYTES = 4 << 20  # bytes of text after which a block is closed
SLICE = 3 << 17  # bytes of text that a pass works on at once


def write_blocks(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Write all columns of docs as blocks; returns their stored names and sizes, (blk, bytes).

    A block is a row group of BLOCK_BYTES of text and one document more at most; a task writes one
    file. Files carry names of their own attempt and count once the table of names holds them.
    """
    frame = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        path = f"blocks/{uuid.uuid4().hex}.parquet"
        sizes: list[int] = []
        held: list[pa.RecordBatch] = []
        trim, rows, size, writer, sink = Trimmer(), 0, 0, None, None

        def close() -> None:
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=len(table))
            sizes.append(size)
            trim()

        for batch in sized(batches, text_col, BLOCK_BYTES // 8, BLOCK_ROWS):
            if writer is None:
                fs.create_dir(f"{base}/blocks", recursive=True)
                sink = fs.open_output_stream(f"{base}/{path}")
                writer = pq.ParquetWriter(sink, batch.schema, compression="zstd")
            held.append(batch)
            rows += batch.num_rows
            size += pa.compute.sum(pa.compute.binary_length(batch.column(text_col))).as_py()
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                close()
                held, rows, size = [], 0, 0
        if held:
            close()
        if writer is not None:
            writer.close()
            sink.close()
        yield pa.RecordBatch.from_pydict({"blk": pa.array([f"{folder}/{path}#{k}" for k in range(len(sizes))], pa.string()), "bytes": pa.array(sizes, pa.int64())})

    # A row a block: few files.
    return stored(frame.mapInArrow(run, "blk string, bytes long").repartition(max(1, width(docs.sparkSession) // 16)), folder, "names")


def load_block(blk: str, columns: list[str] | None = None) -> pa.Table:
    uri, group = blk.rsplit("#", 1)
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return pq.ParquetFile(f).read_row_group(int(group), columns=columns)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts and the last ends."""
    array = column.cast(pa.large_string()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(limits: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts a..b of about `most` bytes, one text at least."""
    n = len(limits) - 1
    group = (limits[1:] - limits[0]) // most if n else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def per_block(blocks: DataFrame, work: Callable[[str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run work(blk) on every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = Trimmer()
        for batch in batches:
            for blk in batch.column("blk").to_pylist():
                yield from work(blk)
                trim()

    return blocks.select("blk").repartition(width(blocks.sparkSession)).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches, key by key."""
    current, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != current:
                yield current, held
                held = []
            current = key
            held.append(row)
    if held:
        yield current, held


def per_key(rows: DataFrame, keys: list[str], work: Callable[[tuple, list[dict]], Iterator[pa.RecordBatch]], schema: str, place: Column | None = None) -> DataFrame:
    """Run work(key, rows) for every key; the rows of one key are in memory, keys one after another.

    place, a whole number that depends on the key alone, says which partition (modulo their number)
    a key goes to; keys that are as large as each other are dealt evenly that way, not by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = Trimmer()
        for key, held in runs(batches, keys):
            yield from work(key, held)
            del held
            trim()

    n = width(rows.sparkSession)
    dealt = rows.repartition(n, *keys) if place is None else rows.repartitionById(n, F.pmod(place, F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard frame."""
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8).tolist()
    out, at = [], 8 + 16 * n
    for kind, size in zip(head[::2], head[1::2]):
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size, at))
        at += size * dtype.itemsize
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of a rising array's steps, most significant bytes together: these compress."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), values.itemsize).T).ravel()


def from_planes(data: np.ndarray, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(data.reshape(size, len(data) // size).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def by_bucket(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the ids of each bucket (id mod buckets), in rising order of place."""
    bucket = (ids % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]

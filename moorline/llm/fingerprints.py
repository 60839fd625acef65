"""Document fingerprints: one-permutation MinHash of 5-word shingles.

Each shingle is hashed once. The high bits of the hash name one of BINS bins, and a bin keeps its
least hash. Empty bins are filled by optimal densification: each bin has a random order of all
bins of its own, the same for all documents, and takes the value of the first of them that is not
empty. The low BITS bits of each bin are packed. Two documents' share of equal bins, corrected for
values that agree by chance, estimates the likeness of their sets.

Neighbours in doc_id order lie in Spark's ranges of (doc_id, hash of the text), so that rows of one
doc_id spread as well: the greatest document of a range goes to the next range too, no range has to
wait for another and no row passes through one task. What the driver holds is a pair of numbers a range.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import shared_folder, sized, stored, whole_ids, width
from moorline.llm.shingles import mix, shingle_hashes

WORDS = 5
BINS = 512
BITS = 8
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAST = -(1 << 63)


@functools.cache
def orders() -> np.ndarray:
    """orders()[i, j]: the place of bin j in bin i's order."""
    keys = mix(np.arange(BINS * BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).reshape(BINS, BINS)
    return keys.argsort(axis=1).argsort(axis=1).astype(np.uint16)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of BINS low-order bytes for each text; a text without words has zeros (and counts as empty)."""
    hashes, offsets = shingle_hashes(texts, WORDS)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    least = np.full(len(texts) * BINS, FAR, np.uint64)
    np.minimum.at(least, of * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), hashes)
    least = least.reshape(-1, BINS)
    full = least != FAR
    out = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    order = orders()
    for i in np.flatnonzero(~full.all(axis=1) & full.any(axis=1)):
        empty, there = np.flatnonzero(~full[i]), np.flatnonzero(full[i])
        out[i, empty] = out[i, there[order[np.ix_(empty, there)].argmin(axis=1)]]
    out[~full.any(axis=1)] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness, row by row; two empty sets are alike, an empty and another are not."""
    chance = 2.0**-BITS
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, out, np.where(some_a | some_b, 0.0, 1.0))


Row = tuple[object, str, np.ndarray, bool]  # doc_id, text, its low-order bytes, whether it has words
ANSWER = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rows_of(ids: list, texts: list[str]) -> list[Row]:
    raw = [t.encode() for t in texts]
    return list(zip(ids, texts, fingerprints(raw), [bool(r.strip(b"\t\n\x0b\x0c\r ")) for r in raw]))


def answers(pairs: list[tuple[Row, Row]], kind: pa.DataType) -> dict[str, pa.Array]:
    """The columns of ANSWER for documents and their next ones."""
    edited = []
    for (_, text, *_), (_, following, *_) in pairs:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    first, second, new = [p[0] for p in pairs], [p[1] for p in pairs], rows_of([None] * len(pairs), edited)
    bits = lambda rows: np.array([r[2] for r in rows]).reshape(-1, BINS)
    some = lambda rows: np.array([r[3] for r in rows], bool)
    packed = lambda rows: pa.array([r[2].tobytes().hex() if r[3] else "" for r in rows], pa.string())
    return {
        "doc_id": pa.array([r[0] for r in first], kind),
        "n_chars": pa.array([len(r[1]) for r in first], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": packed(first),
        "edited_fingerprint": packed(new),
        "near_edited": pa.array(likeness(bits(first), bits(new), some(first), some(new)), pa.float64()),
        "near_next": pa.array(likeness(bits(first), bits(second), some(first), some(second)), pa.float64()),
    }


def places(top_keys: np.ndarray, top_ties: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each (key, tie), ranges being told by their greatest ones in order, and whether it is that greatest one."""
    of = np.searchsorted(top_keys, keys, "left")
    behind = np.searchsorted(top_keys, keys, "right")
    for key in np.unique(keys[of < behind]):  # keys at which ranges end, or that fill several
        rows = np.flatnonzero(keys == key)
        a, b = of[rows[0]], behind[rows[0]]
        of[rows] = a + np.searchsorted(top_ties[a:b], ties[rows], "left")
    return of, (top_keys[of] == keys) & (top_ties[of] == ties)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the next in descending doc_id (null ids last, equal ids by the hashes of
    their texts), after the last the first; a lone document is its own next. Null texts count as
    empty. Fingerprints are hex; a text without words has the empty string. Other columns of docs
    are not carried. An empty table gives an empty table. Ids are whole numbers; others are refused.
    """
    spark = docs.sparkSession
    whole_ids(docs, "doc_id")
    key, text = F.coalesce(F.col("doc_id"), F.lit(LEAST)), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), key.alias("_key"), F.xxhash64(text).alias("_tie"))
    names = ("_key", "_tie")
    # Spark's own ranges of the keys alone, and of each its greatest: a row a partition. Kept once, so
    # that no retry draws others.
    drawn = rows.select(*names).repartitionByRange(4 * width(spark), *names)
    tops = stored(drawn.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct(*names)).alias("top")).select("top.*"), shared_folder(spark), "ranges")
    greatest = tops.orderBy(*names).toPandas()
    bounds = spark.sparkContext.broadcast((greatest["_key"].to_numpy(np.int64), greatest["_tie"].to_numpy(np.int64)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = (batch.column(c).to_numpy() for c in names)
            of, end = places(*bounds.value, keys, ties)
            again = np.flatnonzero(end)  # the greatest of a range goes behind the least of the next one
            for rows, ranges, copy in ((batch, of, 0), (batch.take(again), (of[again] + 1) % len(bounds.value[0]), 1)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ranges, pa.int32()), pa.array(np.full(rows.num_rows, copy), pa.int32())], names=["doc_id", "text", *names, "g", "copy"])

    dealt = rows.mapInArrow(deal, f"doc_id {kind}, text string, _key long, _tie long, g int, copy int")
    dealt = dealt.repartitionById(max(len(greatest), 1), F.col("g")).sortWithinPartitions("copy", F.desc("_key"), F.desc("_tie")).select("doc_id", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: Row | None = None  # the last row, whose next one is yet to come
        for batch in sized(batches, "text", 1 << 20):
            ids = batch.column("doc_id")
            pairs = []
            for row, copy in zip(rows_of(ids.to_pylist(), batch.column("text").to_pylist()), batch.column("copy").to_pylist()):
                if before is not None:
                    pairs.append((before, row))
                before = None if copy else row
            if pairs:
                yield pa.RecordBatch.from_pydict(answers(pairs, ids.type))

    return dealt.mapInArrow(run, ANSWER.format(kind=kind))

"""Best-fit-decreasing packing of token sequences into sequences of a fixed capacity.

Best-fit decreasing looks at nothing but lengths, and there are at most `capacity` different ones.
So the plan is made once from the histogram of lengths, by a segment tree over remaining
capacities: for each length in falling order it finds the tightest open sequences in logarithmic
time and fills all of them that have that same room at once. The plan says, for each run of ranks
among pieces of one length, where they go; it is bounded by the capacity, not by the corpus. Pieces
then look up their place by (length, rank), and ranks are counted file by file, so no length is
ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm import word_bpe
from moorline.llm.common import own, shared_folder, stored, unused

CAPACITY = 4096


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: the least room >= need that is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        k = room + self.size
        while k:
            self.open[k] += count
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """Climb from the leaf until a right sibling has an open sequence, then go down leftmost."""
        k = need + self.size
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence, per sequence, offset), sorted by length and rank.

    Piece number `rank` of its length goes to sequence + (rank - first) // per, at offset +
    ((rank - first) % per) * length.
    """
    tree, groups, opened, out = RoomTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                count = -(-left // (capacity // length))
                groups.setdefault(capacity, []).append((opened, count))
                tree.add(capacity, count)
                opened += count
                room = capacity
            first, count = groups[room].pop()
            tree.add(room, -count)
            per = room // length
            full = min(count, left // per)
            rest = 0 if full == count else left - full * per
            for base, n, items in ((first, full, per), (first + full, int(rest > 0), rest)):
                if n:
                    out.append((length, rank, base, items, capacity - room))
                    rank += n * items
                    groups.setdefault(room - items * length, []).append((base, n))
                    tree.add(room - items * length, n)
            if count > full + (rest > 0):
                groups.setdefault(room, []).append((first + full + (rest > 0), count - full - (rest > 0)))
                tree.add(room, count - full - (rest > 0))
            left -= full * per + rest
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def cut(encoded: DataFrame, capacity: int) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of at most `capacity` ids; a row without ids gives none."""
    n = F.octet_length("ids") / 4
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0)))
    return (
        encoded.filter(F.octet_length("ids") > 0)
        .select("doc_id", "ids", F.explode(pieces).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.expr(f"substring(ids, piece * {4 * capacity} + 1, {4 * capacity})").alias("ids"))
        .withColumn("length", (F.octet_length("ids") / 4).cast("long"))
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row with a `length` (1..capacity) a sequence_id and an offset there.

    Offsets in a sequence are gapless from 0. All columns of pieces keep their names and values;
    where one is called `sequence_id` or `offset`, the new column gets underscores behind its name
    (see `common.unused`). Equal rows are packed each for itself. An empty table gives an empty
    table. Lengths that are null or outside 1..capacity are an error of the caller and fail.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    file, n, before, rank, at = (unused(c, columns) for c in ("file", "n", "before", "rank", "at"))
    table = stored(pieces, shared_folder(spark), "pieces").transform(lambda t: t.withColumn(file, t.metadataColumn("_metadata")["file_path"]))
    counts = table.groupBy("length", file).agg(F.count("*").alias(n))
    # At most `capacity` rows: one for each length that occurs.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum(n)).collect()}
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    steps = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", file, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    # The rank within a file needs no order but its own: any numbers of equal lengths will do.
    local = Window.partitionBy(file, "length").orderBy(F.monotonically_increasing_id())
    ranked = table.withColumn(rank, F.row_number().over(local) - 1).join(offsets, [file, "length"])
    key = steps[:, 0] << 40 | steps[:, 1]  # ranks of one length stay under 2^40

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        step = steps[np.searchsorted(key, size << 40 | r, side="right") - 1]
        nth = r - step[:, 1]
        return pd.DataFrame({"sequence_id": step[:, 2] + nth // step[:, 3], "offset": step[:, 4] + nth % step[:, 3] * size})

    placed = ranked.withColumn(at, place("length", own(rank) + own(before)))
    return placed.select(*map(own, columns), *[own(at)[c].alias(unused(c, columns)) for c in ("sequence_id", "offset")])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack whole documents: (doc_id, piece, start, length, [ids,] ids_crc32, sequence_id, offset).

    Each document is its ids and end_id (a null or empty text: end_id alone). Only documents over
    the capacity are cut, into pieces of `capacity`, the last one shorter.
    """
    pieces = cut(word_bpe.encode(docs, tokenizer, end_id), capacity).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32"]
    return pack(pieces.select(*columns), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): the packed pieces' ids laid one behind the other."""
    return packed.groupBy("sequence_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(offset, hex(ids) as h))), x -> x.h), '')").alias("h")).select("sequence_id", F.unhex("h").alias("ids"))

"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Row numbers 0..n-1 follow ascending doc_id. The network works on pairs below side * side, side the
least whole number with side * side >= n; a result of n or more is sent through again (cycle
walking), so the whole is a permutation of 0..n-1. Position p of it is shard p mod shards, slot
p div shards: both follow from the row number alone, counts differ by one at most, and the shuffle
needs no exchange of rows. All of it is built-in SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm.common import comparable, own, shared_folder, stored, unused, width

SHARDS = 24
SEED = 20240607
ROUNDS = 4
PRIME = 2147483647


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend below PRIME for each round."""
    out, x = [], seed % PRIME + 1
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = x * 48271 % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


def side_of(n: int) -> int:
    return max(1, math.isqrt(max(n, 1) - 1) + 1)


def feistel_sql(x: str, side: int, seed: int) -> str:
    """One pass of the network over the integer expression x."""
    start = f"named_struct('l', ({x}) div {side}, 'r', ({x}) % {side})"
    keys = ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in round_keys(seed))
    once = f"((s.r * k.a + k.b) % {PRIME}L)"
    mixed = f"((({once} % 46337L) * ({once} div 46337L) + {once}) % {PRIME}L)"
    return f"aggregate(array({keys}), {start}, (s, k) -> named_struct('l', s.r, 'r', (s.l + {mixed}) % {side}L), s -> s.l * {side}L + s.r)"


def permuted(row: Column | str, n: int, seed: int) -> Column:
    """Position of row number `row` in the shuffle of n rows.

    A walk meets each of the side * side - n numbers outside at most once, which bounds its steps.
    """
    side = side_of(n)
    steps = max(1, side * side - n)
    first = feistel_sql(row, side, seed)
    again = feistel_sql("x", side, seed)
    walk = f"aggregate(sequence(1, {steps}), y, (x, i) -> CASE WHEN x < {n}L THEN x ELSE {again} END)"
    return F.expr(f"element_at(transform(array({first}), y -> CASE WHEN y < {n}L THEN y ELSE {walk} END), 1)")


def numbered(rows: DataFrame, key: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """rows with a gapless column `name` 0..n-1 in ascending order of key (nulls first), and n.

    Rows are dealt by ranges of the key and sorted there; a file of the stored table is one range,
    and only the counts of files are summed in order. Rows of equal keys come in any fixed order.
    `name` must be no column of rows; helper columns avoid the names of rows by themselves.
    """
    spark = rows.sparkSession
    columns = [own(c) for c in rows.columns]
    at, part, n, before = (unused(c, [*rows.columns, name]) for c in ("at", "part", "n", "before"))
    values = comparable(rows)
    ties = [v for c, v in zip(rows.columns, values) if c != key]
    sorted_rows = rows.repartitionByRange(width(spark), own(key), F.xxhash64(*values)).sortWithinPartitions(own(key), *ties)
    table = stored(sorted_rows.withColumn(at, F.monotonically_increasing_id()), shared_folder(spark), "numbered")
    counts = table.groupBy(F.shiftright(own(at), 33).alias(part)).agg(F.count("*").alias(n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    total = counts.agg(F.sum(n)).first()[0] or 0
    joined = table.withColumn(part, F.shiftright(own(at), 33)).join(F.broadcast(offsets), part)  # bounded: a row a partition
    return joined.select(*columns, (own(before) + own(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name)), total


def shard(rows: DataFrame, shards: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """rows and `shard` 0..shards-1, `slot` gapless from 0 in each shard.

    All columns of rows keep their names and values; where one is called `shard` or `slot`, the new
    column gets underscores behind its name (see `common.unused`). Equal rows are rows of their own.
    An empty table gives an empty table. Null keys come first. Columns may have any type; the key's
    must have an order.
    """
    number, position = unused("row_number", rows.columns), unused("position", rows.columns)
    table, n = numbered(rows, key, number)
    at = table.withColumn(position, permuted(number, n, seed))
    chosen = F.pmod(own(position), F.lit(shards)).cast("int").alias(unused("shard", rows.columns))
    return at.select(*[own(c) for c in rows.columns], chosen, F.expr(f"{position} div {shards}").alias(unused("slot", rows.columns)))

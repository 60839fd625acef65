"""Embedding near-duplicates: int8 quantised tile products with rigorous error bounds.

Equal vectors are one point with a weight. Points are packed into blocks, written once to the shared
folder; each task multiplies one block with a strip of others. A point x is stored as s*q + e with q
int8 and its error length |e| known, so for unit vectors

    x.y <= s_x s_y (q_x.q_y) + |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|

bounds every cosine from above by one product of codes. Codes are whole numbers that single
precision holds exactly, and a tile is multiplied in single precision, one side scaled; what that
may round is part of the bound. Only pairs whose bound reaches the
threshold are recomputed from the original components in double precision, and that value decides.
Tiles give weighted link counts and spanning edges, never lists of pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import discard, opened, shared_folder, stored, whole_ids, width
from moorline.llm.graph import components

THRESHOLD = 0.9
BLOCK = 4096  # points a block holds on average
STRIP = 4  # neighbouring blocks that one task multiplies a block with


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of s*q and lengths of the errors (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(kept, axis=1) * up, np.linalg.norm(unit - kept, axis=1) * up + 1e-12


class Block:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.ids, self.weights, self.vectors = ids, weights, vectors
        # Components far from 1 would overflow squares: scale by the greatest first.
        top = np.abs(vectors).max(axis=1, keepdims=True)
        part = vectors / top
        self.unit = part / np.linalg.norm(part, axis=1, keepdims=True)
        self.codes, self.scale, self.length, self.error = quantise(self.unit)
        self.wide = self.codes.astype(np.float32)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.ids), self.vectors.shape[1]], "<i8").tobytes()
        return head + self.ids.astype("<i8").tobytes() + self.weights.astype("<i8").tobytes() + self.vectors.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        n, d = np.frombuffer(data, "<i8", 2).tolist()
        return cls(np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i8", n, 16 + 8 * n), np.frombuffer(data, "<f8", n * d, 16 + 16 * n).reshape(n, d))


def linked(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of pairs with cosine >= threshold, a strip of rows at a time."""
    most_length, most_error = b.length.max(), b.error.max()
    scaled = (b.wide * b.scale[:, None]).astype(np.float32).T.copy()
    slack = 1e-6 + 2.0**-22 * a.unit.shape[1]  # more than single precision can lose in a scaled product
    for lo in range(0, len(a.ids), 512):
        rows = slice(lo, lo + 512)
        bound = a.length[rows] * most_error + a.error[rows] * (most_length + most_error)
        need = (threshold - bound - slack) / a.scale[rows]
        product = a.wide[rows] @ scaled
        i, j = np.nonzero(product >= need.astype(np.float32)[:, None])
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            true = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= threshold
            yield x[true], y[true]


def tile(a: Block, b: Block, threshold: float, same: bool) -> pd.DataFrame:
    """Rows (id, links, label) of the points of a tile that have links: weights of their partners,
    and the least id that they reach inside the tile."""
    n = len(a.ids)
    links = np.zeros(n + (0 if same else len(b.ids)), np.int64)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    label = ids.copy()
    shift = 0 if same else n
    for x, y in linked(a, b, threshold, same):
        np.add.at(links, x, b.weights[y])
        np.add.at(links, y + shift, a.weights[x])
        # Hook labels within these pairs until nothing moves; earlier pairs hold through labels.
        while len(x):
            least = np.minimum(label[x], label[y + shift])
            moved = (label[x] != least) | (label[y + shift] != least)
            if not moved.any():
                break
            before = np.concatenate([label[x[moved]], label[y[moved] + shift]])
            after = np.concatenate([least[moved], least[moved]])
            old, at = np.unique(before, return_inverse=True)
            lowest = old.copy()
            np.minimum.at(lowest, at, after)
            where = np.searchsorted(old, label)
            where[where == len(old)] = 0
            hit = old[where] == label
            label[hit] = lowest[where[hit]]
    some = links > 0
    return pd.DataFrame({"id": ids[some], "links": links[some], "label": label[some]})


def usable(embedding: str):
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def digest(vector: str) -> Column:
    """SHA-256 of a vector's components, written so that equal ones (0 and -0 too) are written alike."""
    return F.unhex(F.sha2(F.to_json(F.transform(vector, lambda x: x + F.lit(0.0))), 256))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of table.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never link. A row with a null id links with nothing either. Rows of
    one id count as rows of their own and share a component. An empty table gives an empty table. Ids
    are whole numbers; others are refused.
    """
    spark = table.sparkSession
    whole_ids(table, id_col)
    folder = shared_folder(spark)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = rows.filter(usable("v") & F.col("vec_id").isNotNull())
    # A group of equal vectors is summed up on the map side, however many it has.
    points = stored(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), folder, "points")
    blocks = max(-(-points.count() // BLOCK), 1)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        fs, base = opened(folder)
        fs.create_dir(f"{base}/blocks", recursive=True)
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        block = Block(group.column("id").to_numpy(), group.column("weight").to_numpy(), vectors)
        path = f"blocks/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{base}/{path}") as f:
            f.write(block.to_bytes())
        return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "path": [path]})

    dealt = points.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    names = stored(dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, path string"), folder, "manifest")
    # Tiles of one block and those behind it, made and named by executors: a row a tile.
    left = names.select("dim", "block", F.col("path").alias("left"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("other"))
    tiles_of = left.join(names.select("dim", F.col("block").alias("other"), F.col("path").alias("right")), ["dim", "other"])
    strip = F.expr(f"other div {STRIP}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(folder)

        def load(path: str) -> Block:
            with fs.open_input_stream(f"{base}/{path}") as f:
                return Block.from_bytes(f.read())

        name, a = None, None
        for batch in batches:
            for one, path in zip(batch["left"], batch["right"]):
                if one != name:
                    name, a = one, load(one)
                yield tile(a, a if path == one else load(path), threshold, path == one)

    # A strip of tiles is one key; their number bounds the partitions that have work.
    most = blocks * (-(-blocks // STRIP) + 1) // 2 + 1
    work = tiles_of.select("left", "right", strip.alias("strip")).repartition(min(most, 8 * width(spark)), "left", "strip").sortWithinPartitions("left", "right")
    tiles = stored(work.select("left", "right").mapInPandas(run, "id long, links long, label long"), folder, "tiles")
    discard(spark, f"{folder}/blocks")
    sums = tiles.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(tiles.select(F.col("id").alias("u"), F.col("label").alias("v")), f"{folder}/components")
    facts = points.join(sums, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.select(digest("v").alias("digest"), "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    # Vectors move once, when equal ones are grouped; here their digests do.
    met = good.select("vec_id", digest("v").alias("digest")).join(facts, "digest").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    # Vectors that link with nothing, and rows without an id, take no part in the join.
    rest = rows.filter(~(usable("v") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))

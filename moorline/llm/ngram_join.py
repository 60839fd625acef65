"""Exact n-gram Jaccard join with set-relation skipping.

Documents are sets of word-shingle hashes. One total order of tokens, rare ones first, comes from
counting every token over all blocks; a set that shares too few of its tokens with any other can
link with none and drops out. The others list their prefix tokens in an inverted index dealt out by
token. An index list is kept in blocks by set size and by position, and whole blocks are skipped
that no partner can reach: sizes too far apart, or positions that already stand for too many
differences. What remains only says which sets may hang together; each such cluster is then joined
exactly, in cells of bounded size.

Inside a cell, answers are derived from answers. The row of a set holds its overlap with every set
of the cell. The first set of a group counts its row through the lists of all its tokens; for a set
x that an earlier row shows to be much like z, x's row is z's row plus what the tokens that only x
has find, less what the tokens that only z has find: two short walks instead of a long one, and
exact. Sets equal within a block are one set from the start. In a cluster larger than a cell every
set is first compared with the cluster's leader; sets linked to it are one component, so only the
rest is compared, with cells of all.

Sets are sets of 64-bit hashes of shingles (see `shingles`), and the join is exact on the hashes.
Two given shingles share a hash by chance with a probability of 2^-64; a link between sets that are
not alike would need as many such chances as nine tenths of a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.blocks import by_bucket, flat, from_planes, load_block, pack, per_block, per_key, planes, slices, unpack, write_blocks
from moorline.llm.common import discard, shared_folder, stored, whole_ids, width
from moorline.llm.graph import components
from moorline.llm.shingles import mix, shingle_hashes

CELL = 128  # sets that a cell compares with each other
CELL_TOKENS = 4 << 20  # tokens that the sets of a cell have about
BUCKET_BYTES = 32 << 20  # bytes of text whose tokens are counted in one bucket
CLASS_BITS = 6  # a token's frequency class leads its key


def overlap_needed(n, m, num: int, den: int):
    """Least intersection of sets of n and m tokens with den * intersection >= num * union."""
    return -(-(num * (n + m)) // (num + den))


def most_differences(n, m, num: int, den: int):
    """Most tokens that only one of two linked sets of n and at most m tokens has; it never falls with m."""
    return (den - num) * (n + m) // (den + num)


def shingle_sets(texts: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, rising."""
    data, limits = flat(texts)
    sets: list[np.ndarray] = []
    for a, b in slices(limits):
        hashes, offsets = shingle_hashes([data[limits[i] : limits[i + 1]].tobytes() for i in range(a, b)], words)
        sets += [np.unique(hashes[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
    return sets


def sent_set(tokens: np.ndarray) -> bytes:
    return pack(planes(tokens))


def received_set(blob: bytes) -> np.ndarray:
    return from_planes(unpack(blob)[0], np.uint64)


def block_sets(blk: str, words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids (null as the least integer), set sizes, the sets (sorted hashes) of documents that are the
    first of their set, and for each document the place of that first one."""
    table = load_block(blk, [id_col, text_col])
    sets = shingle_sets(table.column(text_col), words)
    ids = table.column(id_col).to_pylist()
    first: dict[tuple, int] = {}
    of = np.empty(len(sets), np.int64)
    # The first of equal sets is the one of the least id.
    for i in sorted(range(len(sets)), key=lambda i: (ids[i] is None, ids[i] or 0)):
        s = sets[i]
        key = (len(s), int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
        of[i] = first.setdefault(key, i) if ids[i] is not None and len(s) else i
    return np.array([np.iinfo(np.int64).min if d is None else d for d in ids], np.int64), np.array([len(s) for s in sets], np.int64), sets, of


def own_sets(ids: np.ndarray, sets: list[np.ndarray], of: np.ndarray) -> list[int]:
    null = np.iinfo(np.int64).min
    return [i for i in range(len(sets)) if of[i] == i and len(sets[i]) and ids[i] != null]


def short_names(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 more bits of the hash. Tokens that share a name count together: they may
    seem less rare than they are, never rarer."""
    return (tokens % np.uint64(buckets)) << np.uint64(32) | tokens >> np.uint64(32)


class Cell:
    """Finds links within one list of sets, or between sets that are `probe` and all others."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int):
        self.order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.num, self.den = [ids[i] for i in self.order], num, den
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        ends = np.cumsum(np.r_[0, self.sizes])
        _, token, times = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        self.sets = [token[a:b] for a, b in zip(ends[:-1], ends[1:])]  # rising, as the hashes are
        # Lists of the sets that hold each token; a token of one set alone finds nothing but itself.
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)[np.argsort(token, kind="stable")]
        self.start = np.cumsum(np.r_[0, times])
        self.rows: dict[int, np.ndarray] = {}

    def found(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        times = self.start[tokens + 1] - self.start[tokens]
        at = np.repeat(self.start[tokens] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return np.bincount(self.owner[at], minlength=len(self.ids))

    def row(self, x: int) -> np.ndarray:
        """Overlaps of set x with all sets, derived from the most similar earlier row where that is shorter."""
        best, least = None, int(self.sizes[x])
        for z, known in self.rows.items():
            differ = int(self.sizes[z] + self.sizes[x] - 2 * known[x])
            if differ < least:
                best, least = z, differ
        if best is None:
            return self.found(self.sets[x])
        mine, other = self.sets[x], self.sets[best]
        return self.rows[best] + self.found(mine[~np.isin(mine, other, assume_unique=True)]) - self.found(other[~np.isin(other, mine, assume_unique=True)])

    def links(self, probe: list[bool] | None = None) -> list[tuple[int, int]]:
        """Spanning links of the components. With probe, pairs of two that are not probes are not
        looked at (they are one component already, or compared elsewhere)."""
        probing = np.ones(len(self.ids), bool) if probe is None else np.array([probe[i] for i in self.order])
        parent = list(range(len(self.ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for x in np.flatnonzero(probing).tolist():
            row = self.rows[x] = self.row(x)
            linked = row >= overlap_needed(int(self.sizes[x]), self.sizes, self.num, self.den)
            linked[x:] &= ~probing[x:]  # later probes look back at x
            for y in np.flatnonzero(linked).tolist():
                if root(x) != root(y):
                    out.append((self.ids[x], self.ids[y]))
                    parent[root(x)] = root(y)
        return out


def link_components(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs.

    Two documents link when den * |intersection| >= num * |union| of their sets of `words`-word
    shingles. A document of fewer words has its whole sequence as one shingle; without words or text
    its set is empty and it links with nothing. component_id is the least doc_id reachable. Rows of
    one doc_id share a component; a row with a null doc_id links with nothing and has a null
    component. An empty table gives an empty table. Ids are whole numbers; others are refused.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    folder = shared_folder(spark)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = write_blocks(frame, folder)
    buckets = max(width(spark), (blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES)

    def named(blk: str):
        ids, sizes, sets, of = block_sets(blk, words, "doc_id", "text")
        own = own_sets(ids, sets, of)
        tokens = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in own)])
        names, at, times = np.unique(short_names(tokens, buckets), return_inverse=True, return_counts=True)
        return ids, sizes, sets, of, own, tokens, names, at, times

    def count(blk: str) -> Iterator[pa.RecordBatch]:
        names, times = (x for i, x in enumerate(named(blk)) if i in (6, 8))
        cuts = np.searchsorted(names, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [pack(planes(names[cuts[k] : cuts[k + 1]].astype(np.uint32)), np.minimum(times[cuts[k] : cuts[k + 1]], 255).astype(np.uint8)) for k in some]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "blk": pa.array([blk] * len(some), pa.string()), "blob": pa.array(blobs, pa.binary())})

    def classify(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        got = [unpack(r["blob"]) for r in rows]
        names = np.concatenate([from_planes(g[0], np.uint32) for g in got])
        uniq, at = np.unique(names, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([g[1] for g in got]).astype(np.float64), minlength=len(uniq))
        kind = np.where(total <= 1, 0, 1 + np.log2(np.maximum(total, 1)).astype(np.int64)).astype(np.uint8)[at]
        parts = np.split(kind, np.cumsum([len(g[1]) for g in got])[:-1])
        yield pa.RecordBatch.from_pydict({"blk": [r["blk"] for r in rows], "bucket": pa.array([key[0]] * len(rows), pa.int32()), "blob": pa.array([pack(p) for p in parts], pa.binary())})

    def survivors(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Rows by kind: doc (doc_id, size), copy (doc_id, first of its set), own (doc_id, row in the
        block) of sets that may link, and post (bucket of a token, prefix entries)."""
        blk = key[0]
        ids, sizes, sets, of, own, tokens, names, at, _ = named(blk)
        kinds = np.concatenate([np.zeros(0, np.uint8), *(unpack(r["blob"])[0] for r in sorted(rows, key=lambda r: r["bucket"]) if r["blob"] is not None)])
        keys = kinds[at].astype(np.uint64) << np.uint64(64 - CLASS_BITS) | tokens >> np.uint64(CLASS_BITS)
        shared_from = np.uint64(1 << (64 - CLASS_BITS))
        ends = np.cumsum([0, *(len(sets[i]) for i in own)])
        rows_left, entries = [], []
        for i, a, b in zip(own, ends[:-1], ends[1:]):
            n = int(b - a)
            row = np.sort(keys[a:b])
            prefix = n - -(-num * n // den) + 1
            alone = int(np.searchsorted(row, shared_from))
            if alone < prefix:
                rows_left.append(i)
                entries.append((row[alone:prefix], np.full(prefix - alone, ids[i]), np.full(prefix - alone, n), np.arange(alone, prefix)))
        out = [("doc", int(d) if d != np.iinfo(np.int64).min else None, int(n), None) for d, n in zip(ids, sizes)]
        out += [("copy", int(ids[i]), int(ids[of[i]]), None) for i in range(len(of)) if of[i] != i and ids[i] != ids[of[i]]]
        out += [("own", int(ids[i]), int(i), None) for i in rows_left]
        if entries:
            token, doc, n, place = map(np.concatenate, zip(*entries))
            for k, where in by_bucket(mix(token), buckets):
                out.append(("post", k, 0, pack(token[where], doc[where], n[where].astype(np.int32), place[where].astype(np.int32))))
        for a in range(0, len(out), 2000):
            part = out[a : a + 2000]
            yield pa.RecordBatch.from_pydict({"kind": [r[0] for r in part], "blk": [blk] * len(part), "a": pa.array([r[1] for r in part], pa.int64()), "b": pa.array([r[2] for r in part], pa.int64()), "blob": pa.array([r[3] for r in part], pa.binary())})

    def fetch(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The sets of those rows of a block that lie in a cluster."""
        table = load_block(key[0], ["doc_id", "text"]).take([r["row"] for r in rows])
        sets = shingle_sets(table.column("text"), words)
        for a in range(0, len(rows), 2000):
            part = rows[a : a + 2000]
            yield pa.RecordBatch.from_pydict({"component": [r["component"] for r in part], "doc": [r["doc"] for r in part], "size": [len(s) for s in sets[a : a + 2000]], "blob": pa.array([sent_set(s) for s in sets[a : a + 2000]], pa.binary())})

    def clusters(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Edges from the least document of each run of list entries that may link."""
        token, doc, n, place = (np.concatenate(x) for x in zip(*(unpack(r["blob"]) for r in rows)))
        n, place = n.astype(np.int64), place.astype(np.int64)
        for _ in range(2):  # sizes cut a list into blocks; the positions a block can reach cut it down
            order = np.lexsort((n, token))
            token, doc, n, place = token[order], doc[order], n[order], place[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (n[:-1] * den < num * n[1:])] if len(n) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if not len(first):
                break
            group = np.cumsum(new) - 1
            size = np.diff(np.r_[first, len(n)])
            most = n * den // num
            differ = most_differences(n, most, num, den)
            keep = (size[group] > 1) & (place + np.minimum.reduceat(place, first)[group] <= differ)
            token, doc, n, place, group = token[keep], doc[keep], n[keep], place[keep], group[keep]
        if len(doc):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(doc)]))
            pairs = np.unique(np.stack([doc, least], 1)[doc != least], axis=0)
        else:
            pairs = np.zeros((0, 2), np.int64)
        for a in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_pydict({"u": pa.array(pairs[a : a + (1 << 16), 0], pa.int64()), "v": pa.array(pairs[a : a + (1 << 16), 1], pa.int64())})

    blob = "bucket int, blk string, blob binary"
    answer = "blk string, bucket int, blob binary"
    classes = stored(per_key(per_block(blocks, count, blob), ["bucket"], classify, answer, F.col("bucket")), folder, "classes")
    every = classes.unionByName(blocks.select("blk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob")))
    # Sorted by kind, so that a filter on the kind skips the pages of the others.
    found = stored(per_key(every, ["blk"], survivors, "kind string, blk string, a long, b long, blob binary").sortWithinPartitions("kind"), folder, "found")
    discard(spark, f"{folder}/classes")
    near = stored(per_key(found.filter("kind = 'post'").select(F.col("a").cast("int").alias("bucket"), "blob"), ["bucket"], clusters, "u long, v long", F.col("bucket")), folder, "near")
    cluster = components(near, f"{folder}/clusters")
    rows = found.filter("kind = 'own'").select("blk", F.col("a").alias("doc"), F.col("b").alias("row")).join(cluster, F.col("doc") == F.col("node")).select("blk", "doc", "row", "component")
    sets = stored(per_key(rows, ["blk"], fetch, "component long, doc long, size long, blob binary"), folder, "sets")
    for name in ("blocks", "near", "clusters"):
        discard(spark, f"{folder}/{name}")
    links = stored(joined(sets, folder, num, den), folder, "links")
    for name in ("sets", "large", "led", "rest"):
        discard(spark, f"{folder}/{name}")
    copies = found.filter("kind = 'copy'").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = components(links.unionByName(copies), f"{folder}/components")
    docs_out = found.filter("kind = 'doc'").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return docs_out.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def joined(sets: DataFrame, folder: str, num: int, den: int) -> DataFrame:
    """Spanning links (u, v) of the sets (component, doc, size, blob) of each cluster, compared in cells."""
    schema = "u long, v long"

    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    def cell(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        # A repeated doc_id keeps all its different sets: each is a set of its own under one name.
        held = Cell([r["doc"] for r in rows], [received_set(r["blob"]) for r in rows], num, den)
        yield batch(held.links([r["probe"] for r in rows]))

    def lead(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Every set of a cell against the leader's."""
        leader = next(r for r in rows if r["leads"])
        own = received_set(leader["blob"])
        pairs = []
        for r in rows:
            other = received_set(r["blob"])
            if not r["leads"] and int(np.isin(own, other, assume_unique=True).sum()) >= overlap_needed(len(own), len(other), num, den):
                pairs.append((r["doc"], leader["doc"]))
        yield batch(pairs)

    wanted = F.ceil(F.greatest(F.count("*") / CELL, F.sum("size") / CELL_TOKENS)).cast("int")
    large = stored(sets.groupBy("component").agg(wanted.alias("cells")).filter("cells > 1"), folder, "large")
    one = per_key(sets.join(large, "component", "left_anti").select("component", "doc", "blob", F.lit(True).alias("probe")), ["component"], cell, schema)
    if large.isEmpty():
        return one
    of = sets.join(F.broadcast(large) if large.count() < 10_000 else large, "component")
    leads = F.col("doc") == F.col("component")
    dealt = of.withColumn("cell", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int")))))
    led = stored(per_key(dealt.select("component", "cell", "doc", "blob", leads.alias("leads")), ["component", "cell"], lead, schema, F.shiftright(F.xxhash64("component"), 8) + F.col("cell")), folder, "led")
    tied = led.select(F.col("u").alias("doc")).distinct()
    rest = of.filter(~leads).join(tied, "doc", "left_anti").select("component", "doc", "size", "blob")
    number = rest.groupBy("component").agg(wanted.alias("rests"))
    rest = stored(rest.join(number, "component"), folder, "rest")
    rest = rest.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("rests")).cast("int"))
    tied = tied.unionByName(large.select(F.col("component").alias("doc")))  # a repeated leader has more sets
    settled = of.join(tied, "doc", "left_semi").join(rest.select("component", "rests").distinct(), "component")
    # Cell i * cells + k compares rest i with cell k of the tied; cell rests * (cells + i) + j rest i with rest j >= i.
    cell_of = F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int")
    across = settled.withColumn("k", cell_of).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("component", (F.col("i") * F.col("cells") + F.col("k")).alias("pair"), "doc", "blob", F.lit(False).alias("probe"))
    rest = rest.join(large, "component")
    probes = rest.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("component", (F.col("i") * F.col("cells") + F.col("k")).alias("pair"), "doc", "blob", F.lit(True).alias("probe"))
    among = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("component", (F.col("rests") * (F.col("cells") + F.least("i", "j")) + F.greatest("i", "j")).alias("pair"), "doc", "blob", F.lit(True).alias("probe"))
    two = per_key(among.unionByName(across).unionByName(probes), ["component", "pair"], cell, schema, F.shiftright(F.xxhash64("component"), 8) + F.col("pair"))
    return one.unionByName(led).unionByName(two)

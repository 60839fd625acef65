"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Sorting suffixes only as far as the threshold finds the repeated windows: suffixes that are equal
through WINDOW bytes are one group. The most significant digit of the radix sort is chosen so that
windows can be dealt out before any text moves: the least hash of the GRAM-byte strings inside a
window, its anchor. Equal windows have equal anchors at equal places, and some thirty neighbouring
windows share one anchor. An anchor hash that only one place has ends there; the places of a
repeated one go on together with the bytes around them, and further passes split them digit by
digit (8 bytes each) until groups are single or WINDOW bytes are equal. First whole stretches
around anchors are split, of which equal ones need no further look, then the windows of the rest.

A text that repeats itself (a run of one letter, a ruled line, a table) would send an anchor for
every repeat. A window that equals the one `distance` bytes before it in the same text is a repeat
whatever else there is, and whoever equals it equals that earlier one too; so such windows are
settled where they are found, at any distance, and only the first of them goes on.

Within a block of documents equal stretches are settled before anything is sent, so a text that a
third of all documents share is sent once a block. Hashes that more than HOT blocks have are combined
in parts of the blocks first, so that no task gathers a copy from every block; where such a hash has
many different stretches still (a common line in ever new surroundings), its windows go on one by
one, dealt by the hash of all their bytes. If one part deals a hash that way, the stretches that the
other parts have of it are dealt too, where they meet: its windows all come to the same places.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline.llm.blocks import by_bucket, flat, load_block, pack, per_block, per_key, slices, unpack, write_blocks
from moorline.llm.common import by_place, discard, own, shared_folder, stored, unused, whole_ids, width
from moorline.llm.shingles import mix, powers, running

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM  # furthest that an anchor lies behind the start of its window
SPAN = REACH + WINDOW  # bytes around an anchor that its windows can cover
GROUP_ROWS = 3000  # stretches whose windows are held at once
STRETCH = 1 << 20  # a longer text is searched for anchors in stretches
BUCKET_BYTES = 16 << 20  # bytes of text whose anchors meet in one bucket
HOT = 32  # blocks; hashes of more are combined in parts first
SPREAD = 512  # different stretches of a hot hash in one part, beyond which its windows are dealt in all parts
LOW = np.uint64((1 << 24) - 1)


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor place and anchor hash of every window start in one stretch of bytes."""
    n = len(data)
    sums = running(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    size = 1
    while 2 * size <= REACH + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = REACH + 1 - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & LOW).astype(np.int64)
    return place, grams


def settled_at_once(data: np.ndarray, h: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for anchors all of whose windows repeat windows of the same text that the last anchor of
    the same hash has, at whatever distance. start: where an anchor's text starts."""
    out = np.zeros(len(h), bool)
    order = np.lexsort((place, h, start))
    one, two = order[:-1], order[1:]
    same = (h[two] == h[one]) & (start[two] == start[one])
    one, two = one[same], two[same]
    step = place[two] - place[one]
    inside = lo[two] - step >= start[two]
    near, step = two[inside], step[inside]
    if not len(near):
        return out
    base = int((lo[near] - step).min())
    text = np.concatenate([data[base : int(hi[near].max()) + WINDOW], np.zeros(SPAN, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(text, SPAN)
    column = np.arange(SPAN)
    for k in range(0, len(near), 1 << 14):
        i, far = near[k : k + (1 << 14)], step[k : k + (1 << 14)]
        differ = rows[lo[i] - base] != rows[lo[i] - base - far]
        out[i] = ~(differ & (column < (hi[i] - lo[i] + WINDOW)[:, None])).any(axis=1)
    return out


def anchors(data: np.ndarray, limits: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """(hash, place, first window start, last window start) of the anchors of all texts in data, and
    (first, last) window starts that are settled at once."""
    found, gone = [], []
    for a, b in slices(limits):
        base, end = int(limits[a]), int(limits[b])
        for lo in range(base, max(end - WINDOW + 1, base), STRETCH):
            hi = min(end, lo + STRETCH + WINDOW - 1)
            if hi - lo < WINDOW:
                break
            place, grams = _anchors(data[lo:hi])
            starts = np.arange(len(place))
            # Only windows inside one text count: its start is not within WINDOW - 1 of the text's end.
            inner = limits[a : b + 1]
            owner = np.searchsorted(inner, starts + lo, side="right") - 1
            starts = starts[starts + lo + WINDOW <= inner[owner + 1]]
            if not len(starts):
                continue
            at = place[starts]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
            last = np.r_[first[1:], len(at)] - 1
            h, at, one, two = grams[at[first]], at[first] + lo, starts[first] + lo, starts[last] + lo
            again = settled_at_once(data, h, at, one, two, inner[owner[starts[first]]])
            if again.any():
                runs = np.flatnonzero(again)  # neighbours are one run
                new = np.flatnonzero(np.r_[True, one[runs[1:]] != two[runs[:-1]] + 1])
                gone.append((one[runs[new]], two[runs[np.r_[new[1:], len(runs)] - 1]]))
            found.append(tuple(x[~again] for x in (h, at, one, two)))
    none = np.zeros(0, np.int64)
    return (tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), none, none, none)), (tuple(map(np.concatenate, zip(*gone))) if gone else (none, none))


def split(label: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Radix passes: rows share a label afterwards if they shared one and all their digits are equal."""
    label = label.copy()
    active = np.arange(len(label))
    for d in range(-1, digits.shape[1]):
        if not len(active):
            break
        digit = digits[active, d] if d >= 0 else np.zeros(len(active), np.uint64)
        order = np.lexsort((digit, label[active]))
        rows, digit = active[order], digit[order]
        old = label[rows]
        new = np.r_[True, (old[1:] != old[:-1]) | (digit[1:] != digit[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        sizes = np.diff(np.r_[first, len(rows)])
        label[rows] = rows[first][group]
        active = rows[sizes[group] > 1]
    return label


def later_ones(label: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """True for all but the lowest-ranked row of each label."""
    order = np.lexsort((rank, label))
    out = np.zeros(len(label), bool)
    out[order[1:]] = label[order[1:]] == label[order[:-1]]
    return out


def contexts(data: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The SPAN bytes around each anchor, zero outside what its windows lo..hi cover."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[place]
    column = np.arange(SPAN)
    out[(column < (REACH - (place - lo))[:, None]) | (column >= (REACH + WINDOW - (place - hi))[:, None])] = 0
    return out


def same_stretches(h: np.ndarray, back: np.ndarray, ahead: np.ndarray, around: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """True for anchors whose whole stretch an earlier anchor has too. back/ahead: the greatest and
    the least distance of the anchor behind the starts of its windows."""
    # Only rows with equal hashes can be equal: single ones need no bytes compared.
    digits = np.concatenate([around.view(np.uint64), (back << 8 | ahead).astype(np.uint64)[:, None]], axis=1)
    return later_ones(split(np.unique(h, return_inverse=True)[1], digits), rank)


def repeated_windows(h: np.ndarray, back: np.ndarray, ahead: np.ndarray, around: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance behind the window's start) of windows that an earlier row has too; rows have
    different stretches."""
    order = np.argsort(h, kind="stable")
    cut = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    sizes = np.diff(np.r_[cut, len(order)])
    out_row, out_back = [], []

    def compare(rows: np.ndarray, row: np.ndarray, distance: np.ndarray) -> None:
        """Windows of `rows` (their places in `row`), each `distance` before its anchor."""
        block = np.concatenate([around[rows].ravel(), np.zeros(8, np.uint8)])
        text = np.lib.stride_tricks.sliding_window_view(block, WINDOW + 4)[row * SPAN + REACH - distance]
        text[:, WINDOW:] = 0
        key = mix(h[rows[row]] + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = later_ones(split(np.unique(key, return_inverse=True)[1], np.ascontiguousarray(text).view(np.uint64)), rank[rows[row]])
        out_row.append(rows[row[again]])
        out_back.append(distance[again])

    some = order[np.repeat((sizes > 1) & (sizes <= GROUP_ROWS), sizes)]
    for part in same_hashes(h[some], GROUP_ROWS):
        rows = some[part]
        compare(rows, *all_windows(back[rows], ahead[rows]))
    for k in np.flatnonzero(sizes > GROUP_ROWS):  # a large group distance by distance
        rows = order[cut[k] : cut[k] + sizes[k]]
        for d in range(int(ahead[rows].min()), int(back[rows].max()) + 1):
            row = np.flatnonzero((ahead[rows] <= d) & (d <= back[rows]))
            compare(rows, row, np.full(len(row), d))
    return (np.concatenate(out_row), np.concatenate(out_back)) if out_row else (np.zeros(0, np.int64),) * 2


def same_hashes(h: np.ndarray, most: int = 40_000) -> Iterator[np.ndarray]:
    """Places in parts of about `most`, in order of hash; equal hashes are in one part."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    cuts = np.unique(np.r_[starts[np.searchsorted(starts, np.arange(0, len(h), most), side="right") - 1], len(h)])
    yield from (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def window_bytes(around: np.ndarray, row: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The windows that start `distance` before the anchors of the stretches `row`."""
    block = around.ravel() if len(around) else np.zeros(SPAN, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(block, WINDOW)[row * SPAN + REACH - distance]


def all_windows(back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of every window of every stretch."""
    times = back - ahead + 1
    row = np.repeat(np.arange(len(times)), times)
    return row, np.repeat(back, times) - (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))


def ranked(doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.lexsort((place, tie, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def covered(place: np.ndarray, row: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first byte, end) that repeated windows cover."""
    order = np.lexsort((-distance, row))
    row, start = row[order], place[row[order]] - distance[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(row)] - 1 if len(row) else new
    return row[new], start[new], start[last] + WINDOW


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs and `n_bytes`, `n_removed` long, `spans` array<struct<start, end>>, `kept` binary; with_text
    also `kept_text` string, which is kept without cut characters.

    A byte goes if a WINDOW-byte string over it also starts earlier: in a document of a smaller id,
    or in the same one before. Matches never cross documents, and strings are judged on the input.
    Spans are the maximal removed runs, in bytes; kept may end inside a character. Null texts count
    as empty and come back empty; null ids come before all others; rows of one id are taken in any
    fixed order. Columns of docs keep their names and values: a new column whose name is taken gets
    underscores behind it (see `common.unused`). An empty table gives an empty table. Ids are whole
    numbers; others are refused.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    folder = shared_folder(spark)
    names_in, docs = docs.columns, by_place(docs)
    id_col, text_col = (f"c{names_in.index(c)}" for c in (id_col, text_col))
    blocks = write_blocks(docs, folder, text_col)
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(width(spark), size // BUCKET_BYTES)
    parts = math.isqrt(count) + 1  # of blocks, for hot hashes

    def searched(blk: str):
        table = load_block(blk, [id_col, text_col])
        data, limits = flat(table.column(text_col))
        (h, place, lo, hi), gone = anchors(data, limits)
        names, of, times = np.unique(h, return_inverse=True, return_counts=True)
        return table, data, limits, h, place, lo, hi, names, of, times, gone

    def tell(blk: str) -> Iterator[pa.RecordBatch]:
        names = searched(blk)[7]
        rows = [(k, pack(names[at])) for k, at in by_bucket(names, buckets)]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blk": pa.array([blk] * len(rows), pa.string()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def repeated(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """For each block, which of its hashes other blocks have too, and which of those are hot."""
        lists = [unpack(r["blob"])[0] for r in rows]
        names, of, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        times = np.split(times[of], np.cumsum([len(x) for x in lists])[:-1])
        blobs = [pack(np.packbits(x > 1), np.packbits(x > HOT)) for x in times]
        yield pa.RecordBatch.from_pydict({"blk": [r["blk"] for r in rows], "bucket": pa.array([key[0]] * len(rows), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def messages(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (kind, bucket, part, blk, blob): settled (owner, start, end) for a block; stretch, window
        and spread (hashes whose windows are dealt) for a bucket."""
        kind, bucket, part, blk, blob = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int32()), "part": pa.array(part, pa.int32()), "blk": pa.array(blk, pa.string()), "blob": pa.array(blob, pa.binary())})

    def send(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Settle what this block can alone, send the different stretches of hashes that others have."""
        blk = key[0]
        table, data, limits, h, place, lo, hi, names, of, times, gone = searched(blk)
        shared, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
        answers = {r["bucket"]: r["blob"] for r in rows}
        for k, at in by_bucket(names, buckets):
            shared[at], hot[at] = (np.unpackbits(x)[: len(at)] > 0 for x in unpack(answers[k]))
        keep = np.flatnonzero(shared[of] | (times[of] > 1))
        h, place, lo, hi, shared, hot = h[keep], place[keep], lo[keep], hi[keep], shared[of[keep]], hot[of[keep]]
        owner = np.searchsorted(limits, place, side="right") - 1
        # Ids stay 64-bit whole numbers, nulls or not.
        ids = pa.compute.fill_null(table.column(id_col).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        rank = ranked(ids[owner], owner, place)
        back, ahead = place - lo, place - hi
        of_gone = np.searchsorted(limits, gone[0], side="right") - 1
        out, mine = [], [(of_gone.astype(np.int32), gone[0] - limits[of_gone], gone[1] + WINDOW - limits[of_gone])]
        part_of = zlib.crc32(blk.encode()) % parts
        for part in same_hashes(h):  # the bytes around anchors are held for a part of the hashes at once
            around = contexts(data, place[part], lo[part], hi[part])
            again = same_stretches(h[part], back[part], ahead[part], around, rank[part])
            rest = np.flatnonzero(~again & ~shared[part])
            alone = part[rest]
            row, distance = repeated_windows(h[alone], back[alone], ahead[alone], around[rest], rank[alone])
            row, start, end = covered(place, alone[row], distance)
            whole = part[again]
            doc = np.concatenate([owner[whole], owner[row]])
            mine.append((doc.astype(np.int32), np.concatenate([lo[whole], start]) - limits[doc], np.concatenate([hi[whole] + WINDOW, end]) - limits[doc]))
            for is_hot in (False, True):
                new = np.flatnonzero(~again & shared[part] & (hot[part] == is_hot))
                sent, bytes_of = part[new], around[new]
                for k, at in by_bucket(h[sent], buckets):
                    s = sent[at]
                    blob = pack(h[s], ids[owner[s]], owner[s].astype(np.int32), place[s] - limits[owner[s]], back[s].astype(np.uint8), ahead[s].astype(np.uint8), bytes_of[at].ravel())
                    out.append(("stretch", k, part_of if is_hot else -1, blk, blob))
        out.append(("settled", -1, -1, blk, pack(*map(np.concatenate, zip(*mine)))))
        yield messages(out)

    class Gathered:
        """The stretches of several blocks that met in one bucket."""

        def __init__(self, rows: list[dict]):
            got = [unpack(r["blob"]) for r in rows]
            self.blks = sorted({r["blk"] for r in rows})
            number = {b: i for i, b in enumerate(self.blks)}
            self.h, self.ids, self.owner, self.place, back, ahead = (np.concatenate([g[i] for g in got]) for i in range(6))
            self.back, self.ahead = back.astype(np.int64), ahead.astype(np.int64)
            self.around = np.concatenate([g[6] for g in got]).reshape(-1, SPAN)
            self.sender = np.repeat([number[r["blk"]] for r in rows], [len(g[0]) for g in got])
            self.rank = ranked(self.ids, self.sender.astype(np.int64) << 32 | self.owner, self.place)

        def repeats(self, part: np.ndarray) -> np.ndarray:
            return same_stretches(self.h[part], self.back[part], self.ahead[part], self.around[part], self.rank[part])

        def settled(self, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
            """Runs start..end of the documents of the stretches `at`, told to their blocks."""
            return [("settled", -1, -1, self.blks[k], pack(self.owner[at[m]], start[m], end[m])) for k in range(len(self.blks)) if (m := self.sender[at] == k).any()]

        def whole(self, at: np.ndarray) -> list[tuple]:
            return self.settled(at, self.place[at] - self.back[at], self.place[at] - self.ahead[at] + WINDOW)

        def deal(self, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Settle equal windows of the different stretches `at` and send the first ones on, one by one."""
            repeat, far = repeated_windows(self.h[at], self.back[at], self.ahead[at], self.around[at], self.rank[at])
            yield messages(self.settled(*covered(self.place, at[repeat], far)))
            every, distances = all_windows(self.back[at], self.ahead[at])
            first = ~np.isin(every << 8 | distances, repeat << 8 | far)
            every, distances = every[first], distances[first]
            for a in range(0, len(every), 16_000):
                s, distance = at[every[a : a + 16_000]], distances[a : a + 16_000]
                text = window_bytes(self.around, s, distance)
                name = mix((text.astype(np.uint64) * powers(WINDOW)[0]).sum(axis=1, dtype=np.uint64))
                out = []
                for k, w in by_bucket(name, buckets):
                    for b in np.unique(self.sender[s[w]]).tolist():
                        x = w[self.sender[s[w]] == b]
                        out.append(("window", k, -1, self.blks[b], pack(name[x], self.ids[s[x]], self.owner[s[x]], self.place[s[x]] - distance[x], text[x].ravel())))
                yield messages(out)

    def combine(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Settle equal stretches of hot hashes among a part of the blocks and send the others on."""
        met, again, dealt = Gathered(rows), [], []
        for part in same_hashes(met.h):
            repeat = met.repeats(part)
            again.append(part[repeat])
            rest = part[~repeat]
            _, of, times = np.unique(met.h[rest], return_inverse=True, return_counts=True)
            dealt.append(rest[times[of] > SPREAD])
            on = rest[times[of] <= SPREAD]
            out = []
            for k in range(len(met.blks)):
                s = on[met.sender[on] == k]
                if len(s):
                    out.append(("stretch", key[0], -1, met.blks[k], pack(met.h[s], met.ids[s], met.owner[s], met.place[s], met.back[s].astype(np.uint8), met.ahead[s].astype(np.uint8), met.around[s].ravel())))
            yield messages(out)
        yield messages(met.whole(np.concatenate(again)))
        at = np.concatenate(dealt)
        if len(at):
            yield messages([("spread", key[0], -1, "", pack(np.unique(met.h[at])))])
            yield from met.deal(at)

    def settle(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Settle stretches; windows of hashes that some part has dealt go where the other windows went."""
        spread = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["blob"])[0] for r in rows if r["kind"] == "spread")])
        rows = [r for r in rows if r["kind"] == "stretch"]
        if not rows:
            return
        met = Gathered(rows)
        found, whole, dealt = [], [], []
        for part in same_hashes(met.h):
            again = met.repeats(part)
            rest = part[~again]
            elsewhere = np.isin(met.h[rest], spread)
            dealt.append(rest[elsewhere])
            rest = rest[~elsewhere]
            row, distance = repeated_windows(met.h[rest], met.back[rest], met.ahead[rest], met.around[rest], met.rank[rest])
            found.append(covered(met.place, rest[row], distance))
            whole.append(part[again])
        yield messages(met.whole(np.concatenate(whole)))
        yield messages(met.settled(*map(np.concatenate, zip(*found))))
        at = np.concatenate(dealt)
        if len(at):
            yield from met.deal(at)

    def settle_windows(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        got = [unpack(r["blob"]) for r in rows]
        name, ids, owner, start = (np.concatenate([g[i] for g in got]) for i in range(4))
        text = np.zeros((len(name), -(-WINDOW // 8) * 8), np.uint8)
        text[:, :WINDOW] = np.concatenate([g[4] for g in got]).reshape(-1, WINDOW)
        blks = sorted({r["blk"] for r in rows})
        number = {b: i for i, b in enumerate(blks)}
        sender = np.repeat([number[r["blk"]] for r in rows], [len(g[0]) for g in got])
        rank = ranked(ids, sender.astype(np.int64) << 32 | owner, start)
        again = np.flatnonzero(later_ones(split(np.unique(name, return_inverse=True)[1], text.view(np.uint64)), rank))
        yield messages([("settled", -1, -1, blks[k], pack(owner[m], start[m], start[m] + WINDOW)) for k in range(len(blks)) if len(m := again[sender[again] == k])])

    carried = T.StructType([*docs.schema.fields])
    names_out = carried.names

    def rewrite(key: tuple, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        table = load_block(key[0])
        data, limits = flat(table.column(text_col))
        got = [unpack(r["blob"]) for r in rows if r["blob"] is not None]
        doc, start, end = (np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]) for i in range(3))
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        # Runs that touch are one: ends only grow within a document, as a running maximum shows.
        if len(doc):
            shift = doc * (int(end.max()) + 1)
            reach = np.maximum.accumulate(end + shift)
            fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] + shift[1:] > reach[:-1])])
            last = np.r_[fresh[1:], len(doc)] - 1
            doc, start, end = doc[fresh], start[fresh], (reach - shift)[last]
        per = np.searchsorted(doc, np.arange(len(limits)))
        for a, b in slices(limits):
            kept, spans, removed = [], [], []
            for i in range(a, b):
                text = data[limits[i] : limits[i + 1]]
                own = list(zip(start[per[i] : per[i + 1]].tolist(), end[per[i] : per[i + 1]].tolist()))
                spans.append([{"start": s, "end": e} for s, e in own])
                removed.append(sum(e - s for s, e in own))
                edges = [0, *(x for se in own for x in se), len(text)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
            part = table.slice(a, b - a)
            columns = {c: part.column(c).combine_chunks() for c in names_out}
            columns["n_bytes"] = pa.array(np.diff(limits[a : b + 1]).astype(np.int64))
            columns["n_removed"] = pa.array(removed, pa.int64())
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns["kept"] = pa.array(kept, pa.binary())
            if with_text:
                columns["kept_text"] = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            yield from pa.table(columns).combine_chunks().to_batches()

    blob = "bucket int, blk string, blob binary"
    message = "kind string, bucket int, part int, blk string, blob binary"
    told = per_key(per_block(blocks, tell, blob), ["bucket"], repeated, "blk string, bucket int, blob binary", F.col("bucket"))
    told = stored(told, folder, "repeated")
    # Blocks without any answer have no anchors, and so nothing to send.
    sent = stored(per_key(told, ["blk"], send, message), folder, "sent")
    discard(spark, f"{folder}/repeated")
    combined = stored(per_key(sent.filter("part >= 0"), ["bucket", "part"], combine, message, F.col("bucket") + F.col("part")), folder, "combined")
    # Hot hashes are no others' hashes, so they are settled by themselves, before the windows meet.
    hot_ones = stored(per_key(combined.filter("kind in ('stretch', 'spread')"), ["bucket"], settle, message, F.col("bucket")), folder, "hot")
    settled = per_key(sent.filter("kind = 'stretch' and part < 0"), ["bucket"], settle, message, F.col("bucket"))
    windows = combined.filter("kind = 'window'").unionByName(hot_ones.filter("kind = 'window'"))
    answers = settled.unionByName(per_key(windows, ["bucket"], settle_windows, message, F.col("bucket")))
    for told_before in (sent, combined, hot_ones):
        answers = answers.unionByName(told_before.filter("kind = 'settled'"))
    everything = answers.select("blk", "blob").unionByName(blocks.select("blk", F.lit(None).cast("binary").alias("blob")))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "spans": span, "kept": T.BinaryType(), **({"kept_text": T.StringType()} if with_text else {})}
    out = per_key(everything, ["blk"], rewrite, T.StructType([*carried.fields, *[T.StructField(c, kind) for c, kind in kinds.items()]]))
    return out.toDF(*names_in, *[unused(c, names_in) for c in kinds])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, its columns only, with the kept text in the place of the text; a cut character goes whole.
    A column length_col, where there is one, holds the kept text's characters."""
    kept = remove_repeats(docs, id_col, text_col, with_text=True)
    text = own(unused("kept_text", docs.columns))

    def column(c: str):
        if c == text_col:
            return text.alias(c)
        return F.length(text).cast(docs.schema[c].dataType).alias(c) if c == length_col else own(c)

    return kept.select(*map(column, docs.columns))

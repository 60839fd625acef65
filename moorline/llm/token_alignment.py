"""Alignment of two tokenizers over whole texts, and how often their tokens end together.

Both tokenizers encode the whole text first. A place where both have a token that begins with a
space, and where the bytes before it are as many on both sides, is an anchor; anchors cut a document
into windows of token ids. The groups of a window depend on its ids alone, so the alignment of a
window is remembered by its two id tuples, and most windows are looked up. Inside a new window the
shared ends cut the tokens into groups, and the two tokens that end a group are linked.

How many links a pair of ids has in the whole corpus is counted in two steps: a block of documents
counts its pairs, and Spark adds up the blocks' counts. The totals go back to the blocks that hold
the pair, where each document sums its links; texts are tokenised once and links never move.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.blocks import pack, unpack
from moorline.llm.common import Trimmer, shared_folder, sized, stored
from moorline.llm.sentencepiece_bpe import model_at

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 20_000  # text and documents after which a block is closed
BATCH_BYTES = 1 << 19  # text that is tokenised at once
CACHED = 300_000  # windows that a worker remembers
LONGEST = 48  # ids of a window that is remembered
LONG_WORD = 400  # characters of a word, or of superfluous white space, from which tiktoken is left out
RARE = re.compile("[^\\x00-\u024f\u2010-\u2027\u4e00-\u9fa5]")
#: Fixed value: how byte-level tokenizers cut a text into words before they merge.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are
    themselves, the others follow from 256 on in rising order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Encoder of a byte-level tokenizer file; special tokens' strings are plain text.

    Texts of common characters without very long words go through the same merges in tiktoken, which
    is some three times as fast; all others through the tokenizers library. Both give the same ids:
    the file's ids rise in the order of its merges, and the two libraries know the common characters'
    classes alike (tests hold every one of them). tiktoken takes a long word's square of time.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.raw = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True} and spec["normalizer"] is None
        ordered = all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges))
        ranks = {self.raw[i]: i for i in range(256 + len(merges))} if plain and ordered else {}
        self.fast = tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def common(self, text: str) -> bool:
        if self.fast is None or RARE.search(text):
            return False
        words = text.split()
        return max(map(len, words), default=0) <= LONG_WORD and len(text) - sum(map(len, words)) <= 2 * len(words) + LONG_WORD

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [np.array(self.fast.encode_ordinary(t), np.int32) if self.common(t) else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.int32)
        return out


class Aligner:
    """Groups and links of texts, by windows that are remembered."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), model_at(pieces)
        self.length_a = np.array([len(x) for x in self.a.raw], np.int64)
        self.length_b = np.array([len(x) for x in self.b.raw], np.int64)
        self.bytes_a, self.bytes_b = self.length_a.tolist(), self.length_b.tolist()
        self.first_b = 2 * len(self.bytes_a)
        self.spelled = pa.array([f"{i}{sign}" for n, signs in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for sign in signs], pa.large_string())
        self.spaced_a = np.array([x[:1] == b" " for x in self.a.raw])
        self.spaced_b = np.array([x[:1] == b" " for x in self.b.raw])
        self.windows: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}

    def window(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        """For each token of A and of B in one window whether it ends a group, as bytes 0 and 1."""
        long_a, long_b = self.bytes_a, self.bytes_b
        ends_a, ends_b = bytearray(len(a)), bytearray(len(b))
        j = end_a = end_b = 0
        for i, token in enumerate(a):
            end_a += long_a[token]
            while end_b < end_a:
                end_b += long_b[b[j]]
                j += 1
            if end_a == end_b:
                ends_a[i] = ends_b[j - 1] = 1
        return bytes(ends_a), bytes(ends_b)

    def said(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The groups as text, a1,a2|b1;a3|b2,b3: each token's own text is taken from a table, in the
        order of groups, A before B."""
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        which = np.empty(len(a) + len(b), np.int32)
        which[np.arange(len(a)) + np.r_[0, upto_b[:-1]][group_a]] = 2 * a + last_a
        which[np.arange(len(b)) + upto_a[group_b]] = self.first_b + 2 * b + last_b
        return self.spelled.take(pa.array(which)).buffers()[2].to_pybytes()[:-1]

    def aligned(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
        """(ids of A, ids of B, groups as text, links) of each text; none where a tokenizer's bytes are not the text's."""
        every_a = self.a.encode_batch([" " + t if t else "" for t in texts])
        every_b = self.b.encode_batch(texts)
        nothing = (np.zeros(0, np.int32), np.zeros(0, np.int32), b"", np.zeros(0, np.int64))
        raw_a, raw_b, known = self.a.raw, self.b.raw, self.windows
        out = []
        for text, a, b in zip(texts, every_a, every_b):
            whole = (" " + text).encode("utf-8", "surrogatepass")
            list_a, list_b = a.tolist(), b.tolist()
            if not text or b"".join([raw_a[i] for i in list_a]) != whole or b"".join([raw_b[i] for i in list_b]) != whole:
                out.append(nothing)
                continue
            starts_a, starts_b = np.cumsum(self.length_a[a]) - self.length_a[a], np.cumsum(self.length_b[b]) - self.length_b[b]
            marked_a, marked_b = np.flatnonzero(self.spaced_a[a]), np.flatnonzero(self.spaced_b[b])
            _, i, j = np.intersect1d(starts_a[marked_a], starts_b[marked_b], assume_unique=True, return_indices=True)
            cut_a, cut_b = marked_a[i].tolist(), marked_b[j].tolist()
            if not cut_a or cut_a[0]:
                cut_a, cut_b = [0, *cut_a], [0, *cut_b]
            bytes_a, bytes_b = a.tobytes(), b.tobytes()
            ends_a, ends_b = [], []
            for x, y, u, v in zip(cut_a, [*cut_a[1:], len(a)], cut_b, [*cut_b[1:], len(b)]):
                key = (bytes_a[4 * x : 4 * y], bytes_b[4 * u : 4 * v])
                got = known.get(key)
                if got is None:
                    got = self.window(list_a[x:y], list_b[u:v])
                    if y - x + v - u <= LONGEST and len(known) < CACHED:
                        known[key] = got
                ends_a.append(got[0])
                ends_b.append(got[1])
            last_a, last_b = (np.frombuffer(b"".join(x), np.uint8) for x in (ends_a, ends_b))
            links = a[last_a > 0].astype(np.int64) << 24 | b[last_b > 0]
            out.append((a, b, self.said(a, b, last_a.astype(np.int64), last_b.astype(np.int64)), links))
        return out


@functools.lru_cache(maxsize=2)
def aligner_at(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


BLOCK = "blk string, documents array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string>>, links binary, pairs array<long>, times array<long>"


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of two tokenizer files: a byte-level one (A, of space+text) and a piece
    model (B, which adds the space).

    documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for
    each row of docs. pairs: (a, b, links, best), every pair of ids that is linked anywhere, how
    often, and whether no other A id is linked with b more often. Texts that are null, empty or not
    the bytes of both encodings have no tokens. Ids may be null or repeat; an empty table gives empty
    ones; other columns are not carried.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its documents, where their links lie, its distinct pairs and their counts."""
        own, trim = aligner_at(byte_level, pieces), Trimmer()
        held: list[tuple] = []
        ids: list[pa.Array] = []
        size = 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(h[3]) for h in held], np.int64)
            pairs, place, times = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            small = place.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
            facts = pa.StructArray.from_arrays(
                [pa.concat_arrays(ids), *(pa.array(x, pa.int64()) for x in ([h[0] for h in held], [h[1] for h in held], sizes)), pa.array([h[2] for h in held], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"],
            )
            row = {
                "blk": pa.array([uuid.uuid4().hex]),
                "documents": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), facts),
                "links": pa.array([pack(sizes, small)], pa.binary()),
                "pairs": pa.array([pairs], pa.list_(pa.int64())),
                "times": pa.array([times], pa.list_(pa.int64())),
            }
            held.clear()
            ids.clear()
            trim()
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in sized(batches, "text", BATCH_BYTES, BLOCK_ROWS):
            texts = batch.column("text").to_pylist()
            ids.append(batch.column("doc_id"))
            for a, b, groups, links in own.aligned(texts):
                held.append((len(a), len(b), hashlib.sha256(groups).hexdigest() if len(a) else "", links))
            size += batch.nbytes
            if size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                yield block()
                size = 0
        if held:
            yield block()

    blocks = stored(frame.mapInArrow(encode, BLOCK.format(kind=kind)), folder, "blocks")
    single = blocks.select("blk", F.inline(F.arrays_zip("pairs", "times")))
    totals = single.groupBy("pairs").agg(F.sum("times").alias("links")).select(F.col("pairs").alias("pair"), F.shiftright("pairs", 24).cast("int").alias("a"), F.col("pairs").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("b"), "links")
    totals = stored(totals, folder, "totals")
    # A piece id has a row for each of its partners; the most of them come before any shuffle.
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    pairs = stored(totals.join(most, "b").select("pair", "a", "b", "links", (F.col("links") == F.col("most")).alias("best")), folder, "pairs")
    answers = single.select("blk", F.col("pairs").alias("pair")).join(pairs.select("pair", "links", "best"), "pair")
    answers = answers.groupBy("blk").agg(F.collect_list(F.struct("pair", "links", "best")).alias("answers"))  # as many as the block has pairs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = Trimmer()
        for batch in batches:
            for k in range(batch.num_rows):
                facts = batch.column("documents")[k].values
                sizes, place = unpack(batch.column("links")[k].as_py())
                got = batch.column("answers")[k].values
                if got is None:
                    count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    order = np.argsort(got.field("pair").to_numpy())
                    count, best = got.field("links").to_numpy()[order], got.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                ends = np.cumsum(np.r_[0, sizes])
                total = lambda x: np.diff(np.r_[0, np.cumsum(x[place])][ends])
                sums = [pa.array(x, pa.int64()) for x in (sizes, total(best), total(count))]
                yield pa.RecordBatch.from_arrays([*(facts.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, facts.field("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
                trim()

    whole = blocks.select("blk", "documents", "links").join(answers, "blk", "left").select("documents", "links", "answers")
    documents = whole.mapInArrow(judge, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return documents, pairs.select("a", "b", "links", "best")

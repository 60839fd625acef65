"""Token ids of a lower-casing word BPE (a tokenizers .json file), remembered by word.

The tokenizer cuts a text into runs of letters, single digits and runs of other characters, none
of which can reach across another, so the ids of a text are those of its words one after the
other. Words are encoded by the vocabulary's merges, many at once, and remembered; a text with anything that
normalisation or special tokens could change is given to the tokenizers library whole, and so is
every text where the file states other rules than those that are known here.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import sized
from moorline.llm.merge_rounds import MergeTable, grouped

CACHED = 200_000  # words that a worker remembers
ROUND_CHARS = 1 << 19  # characters of words that are merged together
#: Texts of these characters are in NFC and lower-case one by one into letters of WORDS.
PURE = re.compile("[\t\n\r -&(-^`-~À-ÖØ-öø-įı-ſ]*")
#: The tokenizer's own alternatives over such a text, lower-cased, without white space.
WORDS = re.compile("[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")


#: The rules that WORDS and PURE stand for, as a tokenizer file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def known_rules(file: dict) -> bool:
    """Whether a tokenizer file states the rules of this module: then words can be encoded apart."""
    model = file["model"]
    return (
        file.get("normalizer") == NORMALIZER
        and file.get("pre_tokenizer") == PRE_TOKENIZER
        and not file.get("truncation")
        and not file.get("padding")
        and all("<|" in t["content"] for t in file.get("added_tokens", []))
        and all(model.get(k) == v for k, v in MODEL.items())
        and bool(model.get("end_of_word_suffix"))
    )


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable Latin-1 for itself, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.apart = known_rules(file)
        if self.apart:
            self.read(file["model"])
        self.cache: dict[str, bytes] = {}
        self.loaded = None

    def read(self, model: dict) -> None:
        vocab, suffix, pairs = model["vocab"], model["end_of_word_suffix"], {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[left] << 24 | vocab[right]] = (rank, vocab[left + right])
        self.table = MergeTable(pairs)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)

    @property
    def library(self):
        """The library's own tokenizer, loaded when a text first needs it."""
        if self.loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of words by vectorised merge rounds."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        symbols, word = self.table.merge(symbols, np.repeat(np.arange(len(raw)), np.diff(ends, prepend=0)))
        cuts = (np.searchsorted(word, np.arange(len(raw) + 1)) * 4).tolist()
        flat = symbols.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = []
        for t in texts:
            # Every character is a letter, a digit or plain punctuation, and no special token is spelled.
            cut.append(WORDS.findall(t.lower()) if self.apart and PURE.fullmatch(t) and "<|" not in t else None)
        out: list[bytes] = [b""] * len(texts)
        get, rows, missing = self.cache.get, [], set()
        for i, words in enumerate(cut):
            if words is None:
                out[i] = self.whole(texts[i])
                continue
            ids = list(map(get, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([words[k] for k in gaps])
            rows.append((i, words, ids, gaps))
        fresh = dict(part for group in grouped(list(missing), ROUND_CHARS) for part in zip(group, self.merged(group)))
        for i, words, ids, gaps in rows:
            for k in gaps:
                ids[k] = fresh[words[k]]
            out[i] = b"".join(ids)
        if len(self.cache) < CACHED:
            self.cache.update((w, x) for w, x in fresh.items() if len(w) <= 40)
        return out


@functools.lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids binary): every whole text's ids and the end id, little-endian unsigned 32-bit.

    A null text counts as empty: its only id is the end id. Order and partitions of docs stay.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return frame.mapInArrow(run, f"doc_id {kind}, ids binary")


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """For batches (doc_id, text): their doc_ids, and each text's ids with the end id."""
    own, end = tokenizer_at(tokenizer), np.array([end_id], "<u4").tobytes()
    for batch in sized(batches, "text", 1 << 20):
        yield batch.column("doc_id"), [x + end for x in own.encode_batch(batch.column("text").to_pylist())]

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into segments between which no vocabulary piece can reach (before a run of spaces,
and between letters and characters that share no piece with a letter). The distinct segments of a
batch lie in one flat numpy symbol array, cut further wherever two neighbouring characters stand
side by side in no piece. Each round takes the minimum pair rank of every stretch at once (a
segmented reduction), merges its places simultaneously, leftmost first, ranks the changed pairs anew
and compacts the array, until no pair remains (`merge_rounds`). Segments of all lengths go this way.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import sized
from moorline.llm.merge_rounds import MergeTable, grouped

SPACE = "▁"
ROUND_CHARS = 1 << 20  # characters of segments that are merged together
CACHED = 400_000  # segments that a worker remembers
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTER = re.compile(f"[{LETTER}]")


class PieceModel:
    """Encoder and decoder of one .model file (BPE with byte fallback, identity normaliser)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte_id = np.zeros(256, np.int32)
        self.raw = []
        self.is_byte = np.zeros(len(pieces), bool)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.is_byte[i] = i, True
                self.raw.append(bytes([value]))
            else:
                self.raw.append({1: p.piece.replace(SPACE, " "), 2: " ⁇ "}.get(p.type, "").encode())
        levels = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces if p.type == 1}, reverse=True))}
        table = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    table[a << 24 | b] = (levels[model.pieces[i].score], i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space behind another character are not supported")
        self.table = MergeTable(table)
        self.beside = np.array(sorted({ord(x) << 21 | ord(y) for p in self.ids for x, y in zip(p, p[1:])}), np.int64)
        # Characters that share a piece with a letter: texts that hold one are cut at spaces only.
        bound = set()
        for piece in self.ids:
            for x, y in zip(piece, piece[1:]):
                if bool(_LETTER.match(x)) != bool(_LETTER.match(y)):
                    bound |= {x, y}
        binding = "".join(sorted(c for c in bound if not _LETTER.match(c) and c != SPACE))
        self.binding = re.compile(f"[{re.escape(binding)}]" if binding else r"(?!)")
        self.fine = re.compile(f"{SPACE}*[{LETTER}]+|{SPACE}*[^{LETTER}{SPACE}]+|{SPACE}+")
        self.coarse = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, bytes] = {}

    # -- encoding -----------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return (self.coarse if self.binding.search(text) else self.fine).findall(text)

    def merge_rounds(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian int32."""
        flat = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        table = {c: self.ids.get(c, -1) for c in set(flat)}
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        uniq, inverse = np.unique(points, return_inverse=True)
        # A character outside the vocabulary is a symbol of its own that merges with nothing.
        symbols = np.array([table[chr(c)] if table[chr(c)] >= 0 else (1 << 23) | int(c) for c in uniq.tolist()], np.int32)[inverse]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        code = points[:-1].astype(np.int64) << 21 | points[1:]
        place = np.minimum(np.searchsorted(self.beside, code), len(self.beside) - 1)
        stretch = np.cumsum(np.r_[True, (word[1:] != word[:-1]) | (self.beside[place] != code)]) - 1
        of = word[np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])]
        symbols, stretch = self.table.merge(symbols, stretch)
        symbols, word = self.spell(symbols, of[stretch])
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        data = symbols.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def spell(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters outside the vocabulary by the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >> 23)
        if not len(odd):
            return symbols, word
        points = symbols[odd] & 0x1FFFFF
        spelled = {c: self.byte_id[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in np.unique(points).tolist()}
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(spelled[c]) for c in points.tolist()]
        out = np.repeat(symbols, times)
        where = np.cumsum(times) - times
        of = where[odd]
        for c, ids in spelled.items():
            at = of[points == c]
            for k, i in enumerate(ids):
                out[at + k] = i
        return out, np.repeat(word, times)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin or end ids."""
        get, rows, missing = self.cache.get, [], set()
        for text in texts:
            segments = self.segments(text)
            ids = list(map(get, segments))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([segments[k] for k in gaps])
            rows.append((segments, ids, gaps))
        fresh = dict(part for group in grouped(list(missing), ROUND_CHARS) for part in zip(group, self.merge_rounds(group)))
        out = []
        for segments, ids, gaps in rows:
            for k in gaps:
                ids[k] = fresh[segments[k]]
            out.append(np.frombuffer(b"".join(ids), "<i4"))
        if len(self.cache) + len(fresh) <= CACHED:
            self.cache.update((s, x) for s, x in fresh.items() if len(s) <= 40)
        return out

    # -- decoding -----------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        parts = [raw[i] for i in ids.tolist()]
        try:
            text = b"".join(parts).decode() if all(parts) else self.decode_bad(ids)
        except UnicodeDecodeError:
            text = self.decode_bad(ids)
        first = next((i for i in ids[:64].tolist() if raw[i]), 0)
        return text[1:] if self.prefix and len(ids) and not self.is_byte[first] and first and raw[first][:1] == b" " else text

    def decode_bad(self, ids: np.ndarray) -> str:
        """Each byte that is no part of a whole character becomes one U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run.extend(self.raw[i])
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


@functools.lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string) of every whole text.

    A null text counts as empty and gives no ids and an empty decoded text; ids may be null or
    repeat, each row gives one row; other columns of docs are not carried.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_at(model)
        for batch in sized(batches, "text"):
            ids = own.encode_batch(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([own.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return frame.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")

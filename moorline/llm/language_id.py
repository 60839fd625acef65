"""Language ID by compression: zstandard with one raw-content dictionary for each language.

Learning cuts every labelled text into pieces and keeps a bounded sample of the pieces of each
language as that language's dictionary. A text is lower-cased and cut into blocks, each block is
compressed with every dictionary, and the language with the smallest total wins; narrow margins are
rejected. One rule holds for texts of every length: a block goes behind the last LEAD bytes of the
dictionary, whose own size is taken off again, as zstandard may not compress a few words alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from moorline.llm.common import by_place, own, sized, unused

SAMPLE_PIECES = 500  # most pieces of labelled texts that a language is learnt from
PIECE_CHARS = 512  # characters of a piece; the last one of a text is shorter
BLOCK = 4096  # bytes compressed at once
LEVEL = 7
LEAD = 256
MARGIN = 0.0005  # share of the bytes by which the best must beat the second not to be rejected
UNKNOWN = "und"
OUTPUTS = ("lang_pred", "score", "rejected")
_LATIN = re.compile("[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, pieces: int = SAMPLE_PIECES, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionaries from rows (text, lang): for each lang, `pieces` pieces of `chars` characters at most.

    All labelled texts are cut whole into pieces, and those of the least hashes are kept: the sample
    depends neither on order nor on partitions, no part of a text is favoured, and equal pieces
    count once. These two bounds are the only ones. Rows with a null text or lang, or an empty text,
    are left out. The driver holds the sample: pieces * chars characters a language.
    """
    rows = labelled.filter("text is not null and lang is not null and text != ''").select("lang", "text")
    counts = rows.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / chars)).alias("n")).collect()  # a row a language
    cut = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))).alias("piece"))
    cut = cut.withColumn("place", F.shiftrightunsigned(F.xxhash64("piece"), 1))  # uniform over 0..2^63 - 1
    sizes = {r["lang"]: int(r["n"]) for r in counts}
    chosen: dict[str, list[tuple[int, str]]] = {}
    share = 3
    while len(chosen) < len(sizes):
        # Of hashes up to `share` times the wanted part of a language, all are taken and the least kept.
        tops = {lang: min(1 << 63, share * pieces * (1 << 63) // n) - 1 for lang, n in sizes.items() if lang not in chosen}
        limits = labelled.sparkSession.createDataFrame(list(tops.items()), "lang string, top long")
        found: dict[str, list[tuple[int, str]]] = {}
        for r in cut.join(F.broadcast(limits), "lang").filter("place <= top").select("lang", "place", "piece").distinct().collect():
            found.setdefault(r["lang"], []).append((r["place"], r["piece"]))
        for lang, most in tops.items():
            least = sorted(found.get(lang, ()))[:pieces]
            if len(least) == pieces or most == (1 << 63) - 1:
                chosen[lang] = least
        share *= 8
    return {lang: b"\n".join(p.lower().encode() for _, p in least) for lang, least in sorted(chosen.items())}


class Sizer:
    """Compressed sizes of texts behind one language's dictionary."""

    def __init__(self, data: bytes):
        import zstandard as zstd

        table = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(level=LEVEL)
        self.tool = zstd.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False, write_checksum=False)
        self.lead = data[-LEAD:]
        self.lead_size = len(self.tool.compress(self.lead))

    def size(self, text: bytes) -> int:
        return sum(len(self.tool.compress(self.lead + text[a : a + BLOCK])) - self.lead_size for a in range(0, len(text), BLOCK))


@functools.lru_cache(maxsize=2)
def sizers(dictionaries: tuple[tuple[str, bytes], ...]) -> list[Sizer]:
    return [Sizer(data) for _, data in dictionaries]


def lettered(text: str) -> bool:
    """Whether a text has a letter; fractions, powers and other number signs are none."""
    return _LATIN.search(text) is not None or any(map(str.isalpha, text))


def judged(text: str | None, names: list[str], tools: list[Sizer]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text; see `predict`."""
    if not names or text is None or not lettered(text):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode()
    sizes = np.array([t.size(raw) for t in tools], np.int64)
    best = int(sizes.argmin())
    if len(names) == 1:
        return names[best], 1.0, False
    least, second = (int(x) for x in np.partition(sizes, 1)[:2])
    return names[best], min(1.0, max(0.0, 1.0 - least / second)) if second > 0 else 0.0, second - least < MARGIN * len(raw)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    A null text, or one without letters, or any text when nothing was learnt, is `und` with score 0
    and rejected. Else the score is 1 - best/second compressed size (1 with a single language), and
    the text is rejected where the best beats the second by less than MARGIN of its bytes. Equal
    sizes go to the language that sorts first. All columns of docs keep their names and values;
    where one has the name of a new column, that gets underscores behind it (see `common.unused`).
    """
    items = tuple(sorted(dictionaries.items()))
    names = [lang for lang, _ in items]
    plain, text = by_place(docs), f"c{docs.columns.index(text_col)}"
    carried = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sizers(items)
        for batch in sized(batches, text):
            langs, scores, rejected = zip(*(judged(t, names, tools) for t in batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*carried, *OUTPUTS])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    out = T.StructType([*plain.schema.fields, *[T.StructField(c, kind) for c, kind in zip(OUTPUTS, kinds)]])
    return plain.mapInArrow(run, out).toDF(*docs.columns, *[unused(c, docs.columns) for c in OUTPUTS])


def identify(docs: DataFrame, pieces: int = SAMPLE_PIECES, chars: int = PIECE_CHARS) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict for all: docs and the prediction."""
    return predict(docs, learn(docs.filter(~held_out(F.col("doc_id"))), pieces, chars))


def known(docs: DataFrame) -> DataFrame:
    """The rows of docs, its columns only, whose language is not rejected. docs must have the columns
    doc_id and lang to learn from; without them, `predict` takes dictionaries learnt elsewhere."""
    return identify(docs).filter(~own(unused("rejected", docs.columns))).select(*map(own, docs.columns))

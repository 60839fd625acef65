"""Secrets in whole texts: fixed patterns, and values whose guess cost gives them away.

Three patterns find keyed assignments, access keys and long hexadecimal runs. Beyond them, values in
a credential's context (behind a credential word and a sign or verb, behind `Bearer`, or as the
password of a URL) are judged by what it would cost to guess them: the cheapest segmentation into
dictionary words, dates, repeats, sequences, keyboard walks and brute-force spans, found by dynamic
programming from left to right. A value that costs as many guesses as no word or date does is a
secret. The dictionary holds the words of the corpus itself, counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import shared_folder, sized, stored

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be passed over
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")
WORDS = 20_000  # words of the corpus that the dictionary holds at most
WORD_LENGTHS = (3, 24)
BITS = 10 * math.log2(10)  # a value of 10^10 guesses or more is a secret
LEAST_VALUE = 6
#: Each holds a word of a context pattern; texts without any of them are not searched for contexts.
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "cred", "auth", "bearer", "login", "://")
CONTEXTS = (
    re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|client|auth|signing|encryption)[\x20_.-]?key|auth(?:orization)?|login)["'\])]?(?:[\x20\x09]*(?:=>|->|:=|[:=]=?)[\x20\x09]*|[\x20\x09]+(?:is|was)[\x20\x09]+)["'`<]?([^\s"'`<>]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"""bearer[\x20\x09]+([^\s"'`<>]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"://[^\s/:@]*:([^\s/@]+)@"),
)
TRAILING = ".,;:!?)]}"
CHARACTER = math.log2(10)  # bits of a brute-force character
JOINT = 1.0  # bits of a further segment
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
LEET = str.maketrans("4@31!0$57", "aaeiiosst")
YEARS = range(1900, 2051)
DATE = re.compile(r"(\d{1,4})([-/._]?)(\d{1,2})\2(\d{1,4})", re.ASCII)


def neighbours() -> dict[str, str]:
    """Keys beside each key: left and right, and two in each of the rows above and below."""
    out: dict[str, set[str]] = {}
    place = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    for c, (r, k) in place.items():
        for d, (s, m) in place.items():
            if (r == s and abs(k - m) == 1) or (s == r - 1 and m - k in (0, 1)) or (s == r + 1 and k - m in (0, 1)):
                out.setdefault(c, set()).add(d)
    return {c: "".join(sorted(x)) for c, x in out.items()}


NEAR = neighbours()
STARTS, DEGREE = math.log2(len(NEAR)), math.log2(sum(map(len, NEAR.values())) / len(NEAR))


class Segment(NamedTuple):
    start: int
    end: int
    bits: float
    kind: str


def word_bits(raw: str, rank: int) -> float:
    """Guesses of a dictionary word with this spelling: rank, capitals, letters written as signs."""
    upper = sum(c.isupper() for c in raw)
    lower = sum(c.islower() for c in raw)
    signs = sum(not c.isalpha() for c in raw)
    if not upper:
        capitals = 0.0
    elif raw[0].isupper() and upper == 1 or not lower:
        capitals = 1.0
    else:
        capitals = math.log2(sum(math.comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)) + 1)
    return math.log2(rank + 1) + capitals + signs


def date_bits(value: str) -> float | None:
    """Guesses of a date or a year; None for anything else."""
    if len(value) == 4 and value.isascii() and value.isdigit():
        if int(value) in YEARS:
            return math.log2(len(YEARS))
    if len(value) < 6:
        return None
    m = DATE.fullmatch(value)
    if not m:
        return None
    sign = 2.0 if m[2] else 0.0
    if m[2]:
        parts = [(m[1], m[3], m[4])]
    else:  # without signs the year has four or two digits, day and month two
        n = len(value)
        parts = [(value[:4], value[4:6], value[6:]), (value[:2], value[2:4], value[4:])] if n == 8 else [(value[:2], value[2:4], value[4:])] if n == 6 else []
    for a, b, c in parts:
        for year, x, y in ((a, b, c), (c, a, b)):
            if len(year) in (2, 4) and (len(year) == 2 or int(year) in YEARS) and len(x) <= 2 and len(y) <= 2:
                if any(1 <= int(p) <= 12 and 1 <= int(q) <= 31 for p, q in ((x, y), (y, x))):
                    return math.log2(366 * len(YEARS)) + sign
    return None


def segments(value: str, ranks: dict[str, int]) -> list[list[Segment]]:
    """Segments other than brute force that end before each place of value (place 0 has none).

    Words of every length; dates; and of repeats (units of 1 to 8), sequences and keyboard walks the
    longest one that ends there. A fixed number for each place: the search is linear in the value.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:  # some capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    signs = low.translate(LEET)
    same = {u: 0 for u in range(1, 9)}  # characters in a row that equal the one u before
    rising, delta, walk, turns, way = 1, 0, 1, 0, None
    out: list[list[Segment]] = [[]]
    for e in range(1, n + 1):
        found = []
        for length in range(WORD_LENGTHS[0], min(WORD_LENGTHS[1], e) + 1):
            for spelled in {low[e - length : e], signs[e - length : e]}:
                rank = ranks.get(spelled)
                if rank is not None:
                    found.append(Segment(e - length, e, word_bits(value[e - length : e], rank), "word"))
        if low[e - 1].isdigit():
            for length in (4, *range(6, 11)):
                bits = date_bits(value[e - length : e]) if length <= e else None
                if bits is not None:
                    found.append(Segment(e - length, e, bits, "date"))
        for u in same:
            same[u] = same[u] + 1 if e > u and value[e - 1] == value[e - 1 - u] else 0
            times = same[u] // u + 1
            if times > 1 and u * times >= 3:
                found.append(Segment(e - u * times, e, u * CHARACTER + math.log2(times), "repeat"))
        if e > 1:
            step = ord(low[e - 1]) - ord(low[e - 2])
            if abs(step) == 1 and low[e - 2 : e].isalnum():
                rising = rising + 1 if step == delta else 2
                delta = step
            else:
                rising, delta = 1, 0
            if rising >= 3:
                found.append(Segment(e - rising, e, CHARACTER + math.log2(rising) + 1, "sequence"))
            beside = NEAR.get(low[e - 2], "").find(low[e - 1])
            if beside >= 0:
                # A turn is a change of direction: the same place among the neighbours goes straight on.
                walk, turns, way = walk + 1, turns + (beside != way), beside
            else:
                walk, turns, way = 1, 0, None
            if walk >= 4:
                found.append(Segment(e - walk, e, STARTS + turns * DEGREE + math.log2(walk), "walk"))
        out.append(found)
    return out


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Binary logarithm of the guesses of the cheapest segmentation."""
    ending = segments(value, ranks)
    # Cheapest ways to each place, by whether a brute-force span is open there.
    closed, opened = [0.0], [math.inf]
    for e in range(1, len(value) + 1):
        opened.append(min(opened[-1] + CHARACTER, closed[-1] + CHARACTER + (JOINT if e > 1 else 0)))
        closed.append(min((min(closed[s.start], opened[s.start]) + s.bits + (JOINT if s.start else 0) for s in ending[e]), default=math.inf))
    return min(closed[-1], opened[-1]) if value else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, -) of the three patterns, each leftmost and without overlaps; matches that are too short go."""
    out = []
    low = None
    for hint in ("pass", "secret", "token", "key"):
        low = text.lower() if low is None else low
        if hint in low:
            out += [(m.start(), 0, m.end(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
            break
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return out


def found_spans(text: str, ranks: dict[str, int], bits: float = BITS) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, bits of the value) in order: all base spans, and guessed ones that touch none of them."""
    base = base_spans(text)
    out = [(s, k, e, guess_bits(text[v[0] : v[1]], ranks) if v else None) for s, k, e, v in base]
    low = text.lower()
    if any(h in low for h in HINTS):
        taken = sorted((s, e) for s, _, e, _ in base)
        tried = set()
        for pattern in CONTEXTS:
            for m in pattern.finditer(text):
                value = m[1].rstrip(TRAILING)
                start, end = m.start(1), m.start(1) + len(value)
                if len(value) < LEAST_VALUE or (start, end) in tried or any(s < end and start < e for s, e in taken):
                    continue
                tried.add((start, end))
                cost = guess_bits(value, ranks)
                if cost >= bits:
                    out.append((start, 3, end, cost))
                    taken.append((start, end))
    return sorted(out, key=lambda x: (x[0], x[1]))


def dictionary(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> dict[str, int]:
    """Ranks (from 1) of the most frequent words of all texts, equal ones by their spelling.

    Words are runs of letters, lower-cased, of WORD_LENGTHS characters. All documents are counted.
    Those words are taken whose count no more than `most` words reach or exceed, a class of counts
    whole or not at all (counts up to 1024 each, then 64 classes an octave): what the driver and
    tasks hold is at most `most` words of 24 characters, whatever the corpus.
    """
    spark = docs.sparkSession
    words = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}]+"))
    counts = docs.select(words.alias("word")).filter(F.length("word").between(*WORD_LENGTHS)).groupBy("word").count()
    level = F.when(F.col("count") <= 1024, F.col("count")).otherwise((F.log2("count") * 64).cast("long") + 384)
    counts = stored(counts.withColumn("level", level), shared_folder(spark), "counts")
    lowest, held = None, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):  # some 5,000 levels at most
        held += r["n"]
        if held > most:
            break
        lowest = r["level"]
    if lowest is None:
        return {}
    found = sorted((-r["count"], r["word"]) for r in counts.filter(F.col("level") >= lowest).collect())
    return {word: k + 1 for k, (_, word) in enumerate(found)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[str, int] | None = None, bits: float = BITS) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, bits>>), a row for each row of docs.

    Places count code points, ends are exclusive, spans are in order of start and kind. bits is the
    guess cost of a keyed or guessed value, null for the other kinds. `ranks` is the dictionary, by
    default that of the texts themselves. Null texts count as empty; ids may be null or repeat; an
    empty table gives an empty one; other columns are not carried.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(frame) if ranks is None else ranks)
    kind = frame.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "bits": b} for s, k, e, b in found_spans(text, shared.value, bits)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return frame.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with every span (they may overlap) replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]

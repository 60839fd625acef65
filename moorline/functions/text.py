"""Text columns: all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorline.options import CONTAINED, WINDOW

#: The split pattern of keyword lists.
KEYWORD_SEPARATORS = "(?U)[、,，/；;|｜\\s]+"
#: Han letters, as `normalize` keeps them.
HAN_RUN = "[\\x{4E00}-\\x{9FFF}&&[\\p{L}\\p{N}]]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, and once in the plan, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower-case, and nothing but letters and numbers of any script."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def round_binary(value: Column, digits: int) -> Column:
    """The value's exact binary number rounded to `digits` decimals, ties to even.

    Away from ties plain arithmetic is exact; near one, whole-number arithmetic on value * 2^60
    decides. Values near a tie and below 1/256 may differ in the last digit.
    """
    ten = 10**digits
    scaled = value * ten
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6
    # value = (high * 2^30 + low) / 2^60: two whole numbers whose products with ten fit 64 bits.
    bits = (value * float(1 << 60)).cast("long")
    high, low = F.shiftright(bits, 30) * ten, bits.bitwiseAND(F.lit((1 << 30) - 1)) * ten
    whole = high + F.shiftright(low, 30)  # in units of 2^-30
    rest = whole.bitwiseAND(F.lit((1 << 30) - 1))
    below = low.bitwiseAND(F.lit((1 << 30) - 1))
    floor = F.shiftright(whole, 30)
    above_half = (rest > 1 << 29) | ((rest == 1 << 29) & (below > 0))
    at_half = (rest == 1 << 29) & (below == 0)
    exact = floor + (above_half | (at_half & (floor % 2 == 1))).cast("long")
    return F.when(near_tie, exact).otherwise(F.floor(scaled + 0.5)) / float(ten)


def context_window(text: Column, start: Column, end: Column, sentence: Column) -> Column:
    """WINDOW characters on either side of [start, end); else the sentence, else the whole text."""
    left = F.greatest(start - WINDOW, F.lit(0))
    right = F.least(F.length(text), end + WINDOW)
    valid = start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= start) & (end <= F.length(text))
    return F.when(valid, F.substring(text, left + 1, right - left)).otherwise(F.coalesce(F.nullif(sentence, F.lit("")), text))


def keyword_hits(context: Column, keywords: Column) -> Column:
    """Keywords that occur verbatim in the context, in their order, repeats kept."""
    return F.filter(keywords, lambda k: (k != "") & F.contains(context, k))


def query_texts(text: Column, aliases: Column) -> Column:
    """The mention's text and its expansions, trimmed, in order, each once."""
    trimmed = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(text), trimmed))


def han_characters(context: Column) -> Column:
    """The context's distinct Han characters. Runs of them are taken, each once, and only those are cut
    into characters: a long text is never an array of its characters."""
    runs = F.array_distinct(F.regexp_extract_all(context, F.lit(HAN_RUN), F.lit(0)))
    return F.filter(F.array_distinct(F.split(F.array_join(runs, ""), "")), lambda c: c != "")


def described_share(characters: Column, description: Column) -> Column:
    """Share of the characters that the normalised description holds (of four at least)."""
    matched = F.size(F.filter(characters, lambda c: F.contains(description, c)))
    score = F.least(F.lit(1.0), matched / F.greatest(F.lit(4), F.size(characters)))
    return F.when((F.coalesce(description, F.lit("")) != "") & (F.size(characters) > 0), score).otherwise(F.lit(0.0))


def description_overlap(context: Column, description: Column) -> Column:
    """Share of the context's distinct Han characters that the description holds (of four at least)."""
    return described_share(han_characters(context), normalize(description))


def contained(query: Column, alias: Column) -> Column:
    """One normalised string holds the other; the query has two characters at least, the alias one."""
    return (F.length(query) >= 2) & (alias != "") & (F.contains(alias, query) | F.contains(query, alias))


def contained_similarity(query: Column, alias: Column) -> Column:
    """Similarity of a containing pair: its ratio is known without matching, and lifted to the floor."""
    both = F.length(query) + F.length(alias)
    return F.greatest(2.0 * F.least(F.length(query), F.length(alias)) / both, F.lit(CONTAINED))


def split_keywords(value: Column) -> Column:
    """Parts between separators; a value of 24 characters or less also goes whole."""
    parts = F.filter(F.split(value, KEYWORD_SEPARATORS), lambda p: p != "")
    whole = F.when(F.length(value) <= 24, F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(parts, whole))


def ordered_unique(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def first_or(values: Column, default: str) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))


def is_nil_label(kb_id: Column) -> Column:
    label = F.coalesce(kb_id, F.lit(""))
    return (label == "") | F.startswith(F.upper(label), F.lit("NIL"))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(round_binary(numerator / F.nullif(denominator, F.lit(0)), 4))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(round_binary(2 * precision * recall / F.nullif(total, F.lit(0.0)), 4))


def trace_id(prefix: str) -> Column:
    """prefix-UTC time-8 hex digits. Not deterministic: write it once before using it twice."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))

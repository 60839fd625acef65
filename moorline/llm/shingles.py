"""64-bit hashes of words and word shingles over whole texts, in flat numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Equal words have
equal hashes wherever they lie: each piece of eight bytes is mixed together with its number in the
word, and the pieces' hashes are added up and mixed with the word's length. (Sums of powers alone
will not do: modulo 2^64 they agree for words as regular as abbabaab..., whatever the base.)
"""

from __future__ import annotations

import functools

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(77))
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = int(_RNG.integers(0, 1 << 62)) * 4 + 3
INVERSE = pow(BASE, -1, 1 << 64)
ORDER = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
PIECE = ORDER[-1]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (BASE, INVERSE):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def running(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers, before each place and at the end."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def piece_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the mixed 8-byte pieces of the words at starts."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    first = mix((eights[starts] & low[np.minimum(lengths, 8)]) + PIECE)
    long = np.flatnonzero(lengths > 8)
    if len(long):  # the pieces behind the first one
        more = (lengths[long] - 1) // 8
        row = np.repeat(np.arange(len(long)), more)
        number = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more) + 1
        value = eights[starts[long][row] + 8 * number] & low[np.minimum(lengths[long][row] - 8 * number, 8)]
        pieces = mix(mix(value + PIECE) + mix(number.astype(np.uint64) + ORDER[0]))
        first[long] += np.add.reduceat(pieces, np.cumsum(more) - more)
    return first


def word_hashes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[limits[i]:limits[i+1]], and the words before each text."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = INSIDE[data]
    first = inside[1:] & ~inside[:-1]  # one more place than data
    edges = limits[1:-1]
    first[edges] |= inside[1:][edges]
    starts = np.flatnonzero(first[:-1])
    last = ~inside[1:] & inside[:-1]
    last[edges] |= inside[:-1][edges]
    ends = np.flatnonzero(last)
    return mix(piece_sums(data, starts, ends - starts) + (ends - starts).astype(np.uint64) * PIECE), np.searchsorted(starts, limits)


def shingle_hashes(texts: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the w-word shingles of each text (repeats kept), and the shingles before each text.

    A text of 1 to w - 1 words has its whole sequence as the one shingle; one without words has none.
    """
    limits = np.cumsum([0, *map(len, texts)])
    if not limits[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words, before = word_hashes(np.frombuffer(b"".join(texts), np.uint8), limits)
    count = np.diff(before)
    full = np.maximum(count - w + 1, 0)
    sums = np.zeros(max(len(words) - w + 1, 0), np.uint64)
    for k in range(w):
        sums += words[k : k + len(sums)] * ORDER[k]
    keep = np.zeros(len(words) + 1, np.int32)  # places where a shingle starts
    some = full > 0
    np.add.at(keep, before[:-1][some], 1)
    np.add.at(keep, before[:-1][some] + full[some], -1)
    out = sums[np.cumsum(keep[: len(sums)]) > 0] if len(sums) else sums
    sizes = np.where(count == 0, 0, np.maximum(full, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    short = np.flatnonzero((count > 0) & (count < w))
    if len(short):
        own = []  # arrays wrap around silently, as they should
        for i in short:
            own.append(np.uint64(count[i]) + (words[before[i] : before[i + 1]] * ORDER[: count[i]]).sum(dtype=np.uint64))
        full_at = np.concatenate([[0], np.cumsum(full)])
        out = np.insert(out, full_at[short], np.array(own, np.uint64))
    return mix(out), offsets

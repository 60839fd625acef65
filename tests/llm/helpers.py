"""Small documents with what operators must bear, and brute-force models."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_documents(seed: int = 3, n: int = 120) -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages; ids unique but for the null ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé ßñ"[:7] + "xyz", k=rng.randrange(1, 8))).strip() or "q" for _ in range(80)]
    passage = " ".join(rng.choices(vocab, k=60))
    out, texts = [], [None, "", " \t\n", "one", "One TWO", "word " * 3000, "🙂 emoji 中文 <|endoftext|> ▁x", "a" * 700]
    for i in range(n):
        kind = i % 6
        if i < len(texts):
            text = texts[i]
        elif kind == 0:
            text = rng.choice([t for _, t, *_ in out if t])
        elif kind == 1:
            words = (rng.choice([t for _, t, *_ in out if t and len(t) > 60] or ["x y z"])).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(rng.choices(vocab, k=rng.randrange(0, 90))) + " " + passage
        else:
            text = "\n".join(" ".join(rng.choices(vocab, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6)))
        out.append((i * 7 % 1009 + (i % 3) * 5000, text, rng.choice(["en", "de", None]), "src", len(text or "")))
    return out


def shingle_set(text: str | None, w: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + w]) for k in range(max(1, len(words) - w + 1))) if words else frozenset()


def jaccard_components(docs: list[tuple], w: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, w) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def removed_spans(docs: list[tuple], window: int = 100) -> dict[int, tuple[bytes, list[tuple[int, int]]]]:
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            piece = raw[s : s + window]
            if piece in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(piece)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[d] = (bytes(c for c, g in zip(raw, gone) if not g), spans)
    return out

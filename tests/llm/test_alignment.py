"""Alignment of two tokenizers against the libraries and a plain model."""

import hashlib
import json
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from moorline.llm import queries, token_alignment
from tests.conftest import SMALL
from tests.llm.helpers import SCHEMA, odd_documents

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(docs):
    """doc_id to (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pairs' counts."""
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    names = {i: bytes(byte_of.get(c, 0) for c in p) for p, i in json.load(open(BYTES))["model"]["vocab"].items()}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    aligned, counts = {}, Counter()
    for d, text in docs:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(names[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            aligned[d] = None
            continue
        at, ends = 0, {}
        for i in a:
            at += len(names[i])
            ends[at] = [i]
        at, links, groups, left, right, k = 0, [], [], [], [], 0
        for i in b:
            right.append(i)
            at += len(piece(i))
            if at in ends:
                size = 0
                while True:
                    left.append(a[k])
                    k += 1
                    size += 1
                    if sum(len(names[x]) for x in left) == at - sum(len(piece(x)) for g in groups for x in g[1]):
                        break
                groups.append((left, right))
                links.append((left[-1], i))
                left, right = [], []
        aligned[d] = (a, b, groups, links)
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = {}
    for d, x in aligned.items():
        if x is None:
            out[d] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = x
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out[d] = (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest())
    return out, counts


def texts(seed=4, n=150):
    rng = random.Random(seed)
    alphabet = [*"abcXYZ  \n\t.,'’s1290<|>_-éßñ中文🙂 ▁　́", "<|endoftext|>", "<s>", "<0x41>", "don't", " the", "  ", "\r\n", "it's", "ing", "Ġ", "ſ"]
    out = ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(n)]
    return out + ["", None, " ", "\n", "a" * 5000, "word " * 4000, "no" + "n" * 30 + " stop", "a b  c   d", "Hello world, it's <|endoftext|> fine", "x▁y", "tail ", " lead"]


def test_query_against_a_plain_model(spark, tmp_path):
    docs = list(enumerate(texts())) + [(d + 1000, t) for d, t, *_ in odd_documents(n=40)]
    frame = spark.createDataFrame([(d, t, None, None, 0) for d, t in docs], SCHEMA).selectExpr("*", "1 AS links", "map(1, 2) AS blk")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = plain(docs)
    rows = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want
    assert sum(w[0] > 0 for w in want.values()) > 100 and sum(w[0] == 0 for w in want.values()) > 5


def test_pairs_and_odd_ids(spark):
    docs = [(None, "the same text"), (None, "the same text"), (7, "another text"), (7, None)]
    rows, pairs = token_alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), BYTES, PIECES)
    want, counts = plain([(k, t) for k, (_, t) in enumerate(docs)])
    assert {(r.a, r.b): r.links for r in pairs.collect()} == dict(counts)
    assert sorted(tuple(r)[1:] for r in rows.collect()) == sorted(want.values())
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert all(r.best == (r.links == best[r.b]) for r in pairs.collect())
    none, no_pairs = token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES)
    assert none.collect() == [] and no_pairs.collect() == []


def test_remembered_windows_change_nothing():
    own = token_alignment.Aligner(BYTES, PIECES)
    some = [t for t in texts(9, 40) if t]
    first, again = own.aligned(some), own.aligned(some[::-1])[::-1]
    assert len(own.windows) > 50
    assert [(x[2], x[3].tolist()) for x in first] == [(x[2], x[3].tolist()) for x in again]


def test_both_encoders_agree():
    """On every common character, and on texts of all kinds, whichever way they go."""
    own = token_alignment.ByteLevel(BYTES)
    assert own.fast is not None
    common = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x4E00, 0x9FA6)]]
    some = [f" a{c}b {c}{c} 1{c}2 {c}\n{c}'{c}" for c in common]
    assert all(map(own.common, some)) and not own.common("a" * 401) and not own.common("a" + " " * 500) and not own.common("\u0250")
    some += [t for t in texts(11, 400) if t] + ["Many words in a row, isn't it so? He said they're here 12 times", "x" * 100_000, " \n" * 50_000 + "y"]
    whole = own.tokenizer.encode_batch(some, add_special_tokens=False)
    assert [x.tolist() for x in own.encode_batch(some)] == [e.ids for e in whole]


def test_query_on_the_tables(spark):
    rows = queries.op13_token_alignment(spark, SMALL)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows.filter("n_links != n_groups").isEmpty() and rows.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moorline.llm import packing, queries, sentencepiece_bpe, token_files, word_bpe
from tests.llm.helpers import SCHEMA, odd_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = st.text(st.one_of(st.sampled_from("aeinrst  .,\n'-0123é中▁🙂<|>İßſ_²\x1ć"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5))
def test_sentencepiece_equals_library(texts):
    own, lib = sentencepiece_bpe.model_at(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == lib.encode(text)
        assert own.decode(ids) == lib.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(259, 31999)), max_size=12))
def test_decode_of_any_ids_equals_library(ids):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sentencepiece_bpe.model_at(PIECES).decode(np.array(ids, np.int32)) == lib.decode(ids)


def test_long_segments_equal_library(library):
    for text in ("a" * 5000, "lowerlower" * 300, " " * 900, "\n" * 400, "中" * 300):
        assert sentencepiece_bpe.model_at(PIECES).encode_batch([text])[0].tolist() == library[0].encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5))
def test_word_bpe_equals_library(texts):
    lib = Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, word_bpe.tokenizer_at(WORDS).encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_word_bpe_of_long_words(library):
    texts = ["x" * 3000, "ab " * 2000, "é" * 150]
    for text, ids in zip(texts, word_bpe.tokenizer_at(WORDS).encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library[1].encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(odd_documents(), SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op1(spark, table, library):
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, table).collect()}
    docs = odd_documents()
    assert len(got) == len(docs)
    for d, text, *_ in docs:
        ids = library[0].encode(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library[0].decode(ids).encode()).hexdigest()


def ids_with(library, text, end):
    return np.array([*library[1].encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op2(spark, table, library):
    rows = queries.op2_best_fit_packing(spark, table).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    want = 0
    for d, text, *_ in odd_documents():
        ids = ids_with(library, text, 1)
        for k in range(0, len(ids), 4096):
            part, want = ids[k : k + 4096], want + 1
            r = pieces[d, k // 4096]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(part.tobytes()))
    assert want == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    # As few as best-fit decreasing gives when done one by one.
    assert len(by) == one_by_one([r.length for r in rows], 4096)


def one_by_one(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_equals_one_by_one(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    steps = packing.plan(histogram, 40)
    fill, ends = {}, {}
    for k, (length, rank, sequence, per, offset) in enumerate(steps.tolist()):
        stop = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == length else histogram[length]
        for nth in range(stop - rank):
            fill.setdefault(sequence + nth // per, []).append((offset + nth % per * length, length))
    assert sum(map(len, fill.values())) == len(lengths)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert len(fill) == one_by_one(lengths, 40)


def test_pack_keeps_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (None, 3, None)], "doc_id long, length long, _rank string")
    rows = packing.pack(frame, 8).collect()
    assert sorted((r.length, r.sequence_id is not None) for r in rows) == [(3, True), (5, True), (5, True)]
    assert packing.pack(frame.filter("false"), 8).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame, 4)


def test_sequences_hold_the_ids(spark, table, library):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    packed = packing.pack_documents(docs, WORDS, capacity=64)
    sequences = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_op10(spark, table, library):
    got = {r.doc_id: r for r in queries.op10_token_files(spark, table).collect()}
    at = 0
    for d, text, *_ in sorted(odd_documents(), key=lambda r: r[0]):
        ids = ids_with(library, text, 2)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_bear_null_and_repeated_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b"), (2, "c"), (2, "c"), (1, None)], "doc_id long, text string")
    folder, manifest = token_files.write(frame, WORDS, file_ids=2)
    rows = sorted(token_files.read(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2]
    folder, manifest = token_files.write(frame.filter("false"), WORDS)
    assert token_files.read(spark, folder, manifest).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum([0, *steps])
    coded, _ = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    for a in range(0, len(values), 7):
        for b in {min(a + 1, len(values)), min(a + 70, len(values)), len(values)}:
            assert coded.select_run(a, b).tolist() == values[a:b].tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()


def test_token_file_is_checked():
    data = token_files.file_bytes([3, None], [b"\1\0\0\0", b""])
    file = token_files.TokenFile(data)
    assert file.names(0, 2) == [3, None] and file.names(1, 2) == [None] and file.document(0).tolist() == [1] and file.document(1).tolist() == []
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])

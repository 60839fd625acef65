"""No column of the caller is lost or overwritten, whatever it is called; odd tables; shared folders."""

import base64
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from moorline import scratch
from moorline.llm import language_id, ngram_join, packing, sentencepiece_bpe, sharding, suffix_dedup, token_files, word_bpe
from moorline.llm.common import opened, own, unused
from tests.llm.helpers import odd_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Names of outputs and helpers, of metadata, with dots and in other cases.
NAMES = (
    "shard", "slot", "row_number", "position", "at", "part", "n", "before", "_at", "_part", "_before", "_n", "_position", "sequence_id", "offset", "file", "rank", "_rank", "_file",
    "lang_pred", "SCORE", "rejected", "n_bytes", "n_removed", "spans", "kept", "kept_text", "_metadata", "a.b", "blk", "bucket", "component_id", "place", "row", "shingles", "kept_text_",
)


def named(spark, rows, schema):
    """rows with a column of every name, each holding a value of its own."""
    frame = spark.createDataFrame(rows, schema)
    return frame.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in NAMES if c not in frame.columns])


def values(frame, columns):
    return sorted((tuple(r) for r in frame.select(*map(own, columns)).collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(d, t, lang, s, n) for d, t, lang, s, n in odd_documents(n=60)]
    return named(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_shard_keeps_columns(documents):
    out = sharding.shard(documents, 5)
    assert out.columns == [*documents.columns, "shard_", "slot_"]
    assert values(out, documents.columns) == values(documents, documents.columns)
    assert sorted(out.groupBy("shard_").count().select("count").toPandas()["count"]) == [12] * 5


def test_pack_keeps_columns(documents):
    pieces = documents.withColumn("length", F.col("doc_id") % 7 + 1)
    out = packing.pack(pieces, 8)
    assert out.columns == [*pieces.columns, "sequence_id_", "offset_"]
    assert values(out, pieces.columns) == values(pieces, pieces.columns)
    assert out.filter("sequence_id_ is null or offset_ is null").isEmpty()


def test_language_id_keeps_columns(documents):
    out = language_id.identify(documents)
    assert out.columns == [*documents.columns, "lang_pred_", "score_", "rejected_"]
    assert values(out, documents.columns) == values(documents, documents.columns)


def test_suffix_dedup_keeps_columns(documents):
    others = [c for c in documents.columns if c != "text"]
    out = suffix_dedup.remove_repeats(documents, with_text=True)
    assert out.columns[len(documents.columns) :] == ["n_bytes_", "n_removed_", "spans_", "kept_", "kept_text__"]
    assert values(out, others) == values(documents, others)


def test_pipeline_stages_keep_columns(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    others = [c for c in documents.columns if c not in ("text", "n_chars")]
    before = {r.doc_id: tuple(r) for r in documents.select(*map(own, others)).collect()}
    now = documents
    for name in ("language_id", "ngram_join", "suffix_dedup"):
        now = stages[name](spark, now, "")
        assert now.columns == documents.columns
        got = now.select(*map(own, others)).collect()
        assert got and all(tuple(r) == before[r.doc_id] for r in got)


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b b b b b b", "x"), (1, "a a a a a a", "y"), (1, "a a a a a a", "y"), (2, None, "z"), (None, "q", "n"), (None, "q", "n")]
    out = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, place string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a a a a a a", "y"), (2, None, "z"), (None, "q", "n"), (None, "q", "n")], key=str)


def test_unused_names():
    assert unused("score", ["Score", "score_"]) == "score__" and unused("a", []) == "a"


ODD = [(None, "a b"), (2, None), (2, "c d e"), (2, "c d e"), (3, "")]


def test_token_operators_bear_odd_tables(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, ids string, piece int")
    assert sentencepiece_bpe.encode_decode(frame, PIECES).count() == len(ODD)
    assert sentencepiece_bpe.encode_decode(frame.filter("false"), PIECES).collect() == []
    packed = packing.pack_documents(frame, WORDS)
    assert packed.count() == len(ODD) and packed.filter("doc_id = 2 and length = 1").count() == 1
    assert packing.pack_documents(frame.filter("false"), WORDS).collect() == []
    folder, manifest = token_files.write(frame, WORDS)
    assert token_files.read(spark, folder, manifest).count() == len(ODD)
    got = sorted(((r.doc_id, r.n_shingles) for r in ngram_join.link_components(frame.withColumn("n_shingles", F.lit(9)), 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 1), (2, 0), (2, 1), (2, 1), (3, 0)], key=str)


def test_long_words_equal_the_libraries():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6000)), base64.b64encode(rng.randbytes(6000)).decode(), "ab" * 4000 + "ba" * 3000, "".join(rng.choices("aab", k=5000)), "".join(rng.choices("的一是不了人我在有他", k=3000))]
    lib, own_pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.model_at(PIECES)
    for text, ids in zip(texts, own_pieces.encode_batch(texts)):
        assert ids.tolist() == lib.encode(text) and own_pieces.decode(ids) == lib.decode(ids.tolist())
    words = Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, word_bpe.tokenizer_at(WORDS).encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_rules_go_to_the_library(tmp_path):
    file = json.loads(open(WORDS, encoding="utf-8").read())
    file["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"String": "e"}, "content": "a"}, {"type": "Lowercase"}]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    own_words, text = word_bpe.WordBpe(str(path)), "The letter here is plain."
    assert not own_words.apart
    assert np.frombuffer(own_words.encode_batch([text])[0], "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_shared_folders(spark, monkeypatch):
    folder = scratch.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(f"{folder}/x")
    scratch.discard(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/x")

    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    monkeypatch.setattr(Elsewhere, "conf", type("K", (), {"get": lambda self, *a: None})())
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_folder(Elsewhere())


def test_file_systems_of_object_stores():
    kind, path = opened("file:///tmp/x")
    assert path == "/tmp/x"
    fs, path = opened("s3a://bucket/folder?region=us-east-1")
    assert fs.type_name == "s3" and path == "bucket/folder"


def with_odd_columns(docs):
    return docs.selectExpr("doc_id", "text", "map('k', doc_id) AS m", "parse_json(concat('{\"a\": ', coalesce(doc_id, 0), '}')) AS v", "array(named_struct('x', map(1, text))) AS deep")


def plain_values(frame):
    return sorted((tuple(r) for r in frame.selectExpr("doc_id", "text", "m['k'] AS k", "to_json(v) AS v", "to_json(deep) AS deep").collect()), key=str)


def test_maps_and_variants_keep_their_values(spark):
    docs = with_odd_columns(spark.createDataFrame([(d, t) for d, t, *_ in odd_documents(n=20)] + [(None, "n")] * 2, "doc_id long, text string"))
    assert plain_values(sharding.shard(docs, 3)) == plain_values(docs)


def test_one_of_each_group_with_maps_and_repeated_ids(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = with_odd_columns(spark.createDataFrame([(1, words), (1, words), (1, "other"), (2, words + " more"), (3, "alone here")], "doc_id long, text string"))
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "")
    assert [(r[0], r[2]) for r in plain_values(kept)] == [(1, 1), (3, 3)] and kept.columns == docs.columns

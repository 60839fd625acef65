"""The training-data pipeline: language ID, near-duplicate join, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. The driver writes each result and reads it again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm import language_id, ngram_join, packing, suffix_dedup
from moorline.llm.common import comparable, discard, own, shared_folder, stored, unused

#: Near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject."""
    return language_id.known(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates; all without a doc_id.

    Rows of one doc_id are one document: of its rows, the one with the least text stays (a null text
    before all others), and of rows of one text any, by their hash.
    """
    groups = ngram_join.link_components(docs, WORDS, NUM, DEN)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").select(*map(own, docs.columns))
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        place, row = (unused(c, docs.columns) for c in ("place", "row"))
        whole = F.struct(*map(own, docs.columns))
        least = F.min_by(whole, F.struct("text", place)).alias(row)  # combined on the map side, however often an id repeats
        out = out.withColumn(place, F.xxhash64(*comparable(docs))).groupBy("doc_id").agg(least).select(f"{row}.*")
    return out.select(*map(own, docs.columns)).unionByName(docs.filter("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that suffix-array dedup removes; a cut character goes whole."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", remove_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: No SQL expresses compression classifiers or tokenizers: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over the whole documents table."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

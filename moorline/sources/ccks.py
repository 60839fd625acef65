"""CCKS2019-shaped data: entity lines, labelled documents, and their conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline import schemas
from moorline.functions.text import first_or, ordered_unique, split_keywords
from moorline.options import CCKS_KB
from moorline.sources.kb import subset

#: Predicates whose objects are keywords, and the most keywords kept.
KEYWORD_PREDICATES = ("义项描述", "标签", "中文名", "中文名称", "别称", "外文名", "摘要")
MOST_KEYWORDS = 32
NONE = "array<string>"


def read_entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped. `line` keeps the order of the file."""
    lines = spark.read.schema(schemas.CCKS_ENTITY).json(path).filter("subject_id is not null")
    return lines.withColumn("line", F.monotonically_increasing_id())


def convert_entities(lines: DataFrame, kb_id: str = CCKS_KB) -> DataFrame:
    data = F.coalesce("data", F.array().cast("array<struct<predicate:string,object:string>>"))
    stated = F.filter(data, lambda r: F.coalesce(r["object"], F.lit("")) != "")
    description = F.array_join(F.transform(stated, lambda r: F.concat(F.coalesce(r["predicate"], F.lit("")), F.lit(":"), r["object"])), " ")
    keywords = F.flatten(F.transform(F.filter(data, lambda r: r["predicate"].isin(*KEYWORD_PREDICATES)), lambda r: split_keywords(r["object"])))
    subject = F.coalesce("subject", F.lit(""))
    return lines.select(
        F.lit(kb_id).alias("kb_id"),
        F.lit("ccks2019").alias("version"),
        F.col("line").cast("long").alias("entity_ord"),
        F.col("subject_id").alias("entity_id"),
        subject.alias("canonical_name"),
        ordered_unique(F.concat(F.array(subject), F.coalesce("alias", F.array().cast(NONE)))).alias("aliases"),
        first_or(F.coalesce("type", F.array().cast(NONE)), "Thing").alias("entity_type"),
        F.slice(ordered_unique(keywords), 1, MOST_KEYWORDS).alias("keywords"),
        description.alias("description"),
        F.to_json(F.struct(F.lit("ccks2019").alias("source"), "type", "data")).alias("metadata_json"),
    )


def load_entities(spark: SparkSession, path: str, limit: int | None = None, ids: DataFrame | None = None, alias_texts: DataFrame | None = None, kb_id: str = CCKS_KB) -> DataFrame:
    rows = subset(convert_entities(read_entity_lines(spark, path), kb_id), ids, alias_texts)
    return rows if limit is None else rows.orderBy("entity_ord").limit(limit)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CCKS_DOCUMENT).json(path).filter("text_id is not null or text is not null")


def read_document_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.CCKS_DOCUMENT).json(path)


def document_mentions(documents: DataFrame) -> DataFrame:
    """Mentions with the span that the offset says; gold label beside."""
    rows = documents.select("text_id", F.col("text").alias("doc_text"), F.posexplode("mention_data").alias("pos", "m"))
    start = F.coalesce(F.col("m.offset").cast("int"), F.lit(0))
    return rows.select(
        F.col("text_id").alias("request_id"),
        "doc_text",
        "pos",
        F.concat_ws(":", "text_id", "pos").alias("mention_id"),
        F.col("m.mention").alias("text"),
        start.alias("start"),
        (start + F.length("m.mention")).alias("end"),
        F.lit(None).cast("string").alias("entity_type"),
        F.col("doc_text").alias("sentence"),
        F.array().cast(NONE).alias("candidate_aliases"),
        F.lit(False).alias("coreference_hint"),
        F.col("m.kb_id").alias("gold_kb_id"),
    )


def first_documents(documents: DataFrame, limit: int) -> DataFrame:
    """The first documents by id: evaluation runs on a bounded number."""
    return documents.orderBy("text_id").limit(limit)

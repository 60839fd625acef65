"""Alias priors learnt from labelled mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorline.functions.text import is_nil_label, normalize, round_binary


def counted(labelled: DataFrame, text_col: str = "text", label_col: str = "gold_kb_id") -> DataFrame:
    """(norm_mention, entity_id, n): how often a mention has a label, NIL labels left out. Such counts
    add up: those of two halves are those of the whole (see `merged`).

    Counts are combined before they are shuffled, so a very common mention is a row for each task.
    """
    rows = labelled.filter(~is_nil_label(F.col(label_col))).select(normalize(F.col(text_col)).alias("norm_mention"), F.col(label_col).cast("string").alias("entity_id"))
    return rows.filter("norm_mention != ''").groupBy("norm_mention", "entity_id").agg(F.count("*").alias("n"))


def merged(counts: DataFrame) -> DataFrame:
    """Counts of which a pair may have several rows, added up."""
    return counts.groupBy("norm_mention", "entity_id").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """(norm_mention, entity_id, prior, n) of counts, a row for each pair."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("norm_mention"))
    return counts.withColumn("prior", round_binary(share, 6)).select("norm_mention", "entity_id", "prior", "n")


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "gold_kb_id") -> DataFrame:
    """(norm_mention, entity_id, prior, n): share of a mention's labels, NIL labels left out."""
    return shares(counted(labelled, text_col, label_col))


def count_stream(labelled: DataFrame, table: str, checkpoint: str, text_col: str = "text", label_col: str = "gold_kb_id", available_now: bool = True) -> StreamingQuery:
    """Keep the counts of a stream of labelled mentions in a table, a partition for each micro-batch;
    one that is tried again replaces its own. `learnt` makes the prior of what is there."""

    def write(batch: DataFrame, number: int) -> None:
        counted(batch, text_col, label_col).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = labelled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def learnt(spark: SparkSession, table: str) -> DataFrame:
    """The prior of a table of counts."""
    return shares(merged(spark.read.option("basePath", table).parquet(table).select("norm_mention", "entity_id", "n")))


def trained_mentions(prior: DataFrame) -> DataFrame:
    return prior.agg(F.countDistinct("norm_mention").alias("mentions"))

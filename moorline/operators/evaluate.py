"""Metrics of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.text import f1, is_nil_label, safe_divide


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def benchmark_metrics(predictions: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: overall and link accuracy, NIL precision, recall and F1, alias recall, total, and how
    many gold rows have no prediction.

    predictions: keys, status, linked_entity_id; gold: keys, entity_id, status, is_alias. A gold row
    without a prediction is an error of the caller: it counts as wrong, and `missing_predictions`
    says how many there are.
    """
    rows = gold.select(*keys, F.col("entity_id").alias("want"), (F.col("status") == "nil").alias("gold_nil"), "is_alias").join(predictions.select(*keys, F.col("status").alias("got_status"), F.col("linked_entity_id").alias("got")), keys, "left")
    got_nil = F.coalesce(F.col("got_status") == "nil", F.lit(False))
    hit = F.col("got").eqNullSafe(F.col("want"))
    linked_right = ~F.col("gold_nil") & F.coalesce(F.col("got") == F.col("want"), F.lit(False))
    right = F.when(F.col("gold_nil"), got_nil).otherwise(hit & F.coalesce(F.col("got_status").isin("linked", "ambiguous"), F.lit(False)))
    counted = rows.agg(
        F.count("*").alias("total_mentions"),
        count_if(right).alias("right"),
        count_if(~F.col("gold_nil")).alias("links"),
        count_if(linked_right).alias("links_right"),
        count_if(F.col("gold_nil")).alias("nils"),
        count_if(got_nil).alias("nils_got"),
        count_if(F.col("gold_nil") & got_nil).alias("nils_right"),
        count_if(~F.col("gold_nil") & F.col("is_alias")).alias("aliases"),
        count_if(linked_right & F.col("is_alias")).alias("aliases_right"),
        count_if(F.col("got_status").isNull()).alias("missing_predictions"),
    )
    rated = counted.select(
        safe_divide(F.col("right"), F.col("total_mentions")).alias("overall_accuracy"),
        safe_divide(F.col("links_right"), F.col("links")).alias("link_accuracy"),
        safe_divide(F.col("nils_right"), F.col("nils_got")).alias("nil_precision"),
        safe_divide(F.col("nils_right"), F.col("nils")).alias("nil_recall"),
        safe_divide(F.col("aliases_right"), F.col("aliases")).alias("alias_recall"),
        "total_mentions",
        "missing_predictions",
    )
    return rated.withColumn("nil_f1", f1(F.col("nil_precision"), F.col("nil_recall")))


def split_accuracy(predictions: DataFrame, labelled: DataFrame, keys: list[str], label_col: str = "gold_kb_id") -> DataFrame:
    """One row: overall, linked and NIL accuracy with their counts, NIL told by the label."""
    rows = labelled.select(*keys, F.coalesce(F.col(label_col), F.lit("")).alias("want")).join(predictions.select(*keys, "status", "linked_entity_id"), keys, "left")
    nil = is_nil_label(F.col("want"))
    nil_right = nil & F.coalesce(F.col("status") == "nil", F.lit(False))
    link_right = ~nil & F.coalesce(F.col("linked_entity_id") == F.col("want"), F.lit(False))
    counted = rows.agg(F.count("*").alias("mentions"), count_if(nil_right | link_right).alias("right"), count_if(~nil).alias("linked_mentions"), count_if(link_right).alias("links_right"), count_if(nil).alias("nil_mentions"), count_if(nil_right).alias("nils_right"))
    return counted.select(
        "mentions",
        safe_divide(F.col("right"), F.col("mentions")).alias("overall_accuracy"),
        safe_divide(F.col("links_right"), F.col("linked_mentions")).alias("linked_accuracy"),
        safe_divide(F.col("nils_right"), F.col("nil_mentions")).alias("nil_accuracy"),
        "linked_mentions",
        "nil_mentions",
    )


def distinct_gold(labelled: DataFrame, label_col: str = "gold_kb_id") -> DataFrame:
    """(entity_id) of all labels but NIL ones: what a base's subset is cut to."""
    return labelled.filter(~is_nil_label(F.col(label_col))).select(F.col(label_col).alias("entity_id")).distinct()

"""Scoring of candidates by alias, context, type, canonical name, expansion and learned prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.text import clamp, described_share, keyword_hits, round_binary

#: Weights of the score, in the order in which they are added.
ALIAS, CONTEXT, TYPE, CANONICAL, EXPANSION, PRIOR = 0.62, 0.23, 0.05, 0.03, 0.08, 0.22


def rescore(built: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Candidate rows with context evidence, the final score and all reasons. `prior` is in the rows
    that `retrieve.build` made already; stages of other kinds may look at it here."""
    hits = keyword_hits(F.col("context"), F.col("keywords"))
    scored = built.withColumns({"overlapping_keywords": hits, "description_score": described_share(F.col("characters"), F.col("described"))})
    by_keyword = F.least(F.lit(1.0), F.size("overlapping_keywords") / F.greatest(F.lit(1), F.least(F.size("keywords"), F.lit(4))))
    context = F.greatest(by_keyword, F.col("description_score"))
    expanded = F.col("kind") == "llm_alias_expansion"
    total = (
        F.col("alias_similarity") * ALIAS
        + context * CONTEXT
        + F.when(F.col("type_aligned"), F.lit(TYPE)).otherwise(F.lit(0.0))
        + F.when(F.col("same_name"), F.lit(CANONICAL)).otherwise(F.lit(0.0))
        + F.when(expanded, F.lit(EXPANSION)).otherwise(F.lit(0.0))
        + F.col("prior") * PRIOR
    )
    more = F.array_compact(
        F.array(
            F.when(F.size("overlapping_keywords") > 0, F.lit("context_keyword_support")),
            F.when(F.col("description_score") > 0, F.lit("description_overlap_support")),
            F.when(F.col("prior") > 0, F.lit("alias_prior_support")),
        )
    )
    return scored.withColumns({"score": round_binary(clamp(total), 3), "reasons": F.concat("reasons", more)})


FIELDS = ["rank", "entity_id", "canonical_name", "entity_type", "score", "alias_similarity", "matched_alias", "overlapping_keywords", "reasons"]


def top(rescored: DataFrame, most_k: int) -> DataFrame:
    """The best top_k candidates of a signature; ties keep retrieval order. most_k is the greatest
    top_k: Spark cuts each task's rows to it before they are shuffled."""
    order = Window.partitionBy("sig").orderBy(F.desc("score"), "retrieval_rank")
    slim = rescored.select("sig", "top_k", "retrieved", "retrieval_rank", *FIELDS[1:])
    return slim.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_k).filter(F.col("rank") <= F.col("top_k")).select("sig", "retrieved", *FIELDS)


WHOSE = ("sig", "mark", "asks")


def margins(ranked: DataFrame) -> DataFrame:
    """(WHOSE, top1, top2, margin): the two best scores of each signature; a single one has no margin."""
    best = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return ranked.groupBy(*WHOSE).agg(best(1).alias("top1"), best(2).alias("top2")).withColumn("margin", F.col("top1") - F.col("top2"))


def collected(ranked: DataFrame) -> DataFrame:
    """(WHOSE, candidates, retrieved): at most top_k structs in rank order, and how many there were."""
    return ranked.groupBy(*WHOSE).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("candidates"), F.max("retrieved").cast("long").alias("retrieved"))

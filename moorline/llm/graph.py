"""Connected components by alternating large-star and small-star, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import discard, shared_folder, stored


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node reachable.

    Null ends and loops are dropped. Each round is stored in the shared folder; nothing is
    collected but a count and a checksum of the round's edges.
    """
    spark = edges.sparkSession
    folder = folder or shared_folder(spark)
    now = edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, step = None, 0
    while True:
        now = stored(now, folder, f"edges{step}")
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if step:
            discard(spark, f"{folder}/edges{step - 1}")
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        now = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")).distinct()

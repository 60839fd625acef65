"""Alias indexes as tables, one for each version of a base, bucketed by what retrieval joins on.

A stream links every micro-batch against the same base. Its index is made once: later plans read
buckets instead of exploding, numbering and shuffling the base's aliases again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.sources.kb import alias_index

PREFIX = "moorline_index"


def version_of(entities: DataFrame) -> str:
    """A name for what a base holds: its parts' names, versions and the checksum of their rows."""
    rows = entities.groupBy("kb_id").agg(F.max("version").alias("version"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("entity_ord", "canonical_name", "aliases")).alias("sum"))
    marks = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("kb_id", "version", "n", "sum"))).first()  # one row, whatever the number of bases
    return hashlib.sha256(repr(tuple(marks)).encode()).hexdigest()[:16]


class AliasIndexes:
    """Index tables of this session's catalog. `of` makes the table of a base's version, or finds it."""

    def __init__(self, spark: SparkSession, buckets: int = 64, database: str | None = None):
        self.spark, self.buckets, self.at = spark, buckets, f"{database}." if database else ""

    def name(self, entities: DataFrame, cap: int) -> str:
        return f"{self.at}{PREFIX}_{version_of(entities)}_{cap}"

    def of(self, entities: DataFrame, cap: int) -> DataFrame:
        """(kb_id, norm, entity_ord): the first `cap` entities of each alias, in buckets of (kb_id, norm)."""
        name = self.name(entities, cap)
        if not self.spark.catalog.tableExists(name):
            rows = alias_index(entities, cap).select("kb_id", "norm", "entity_ord")
            rows.write.bucketBy(self.buckets, "kb_id", "norm").sortBy("kb_id", "norm").mode("overwrite").saveAsTable(name)
        return self.spark.table(name)

    def drop_others(self, *kept: str) -> None:
        """Delete the tables of versions that are no longer in use."""
        for t in self.spark.catalog.listTables(self.at.rstrip(".") or None):
            if t.name.startswith(PREFIX) and f"{self.at}{t.name}" not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.at}{t.name}")

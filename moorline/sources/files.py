"""Benchmarks, alias priors, requests and traces as files."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from moorline import schemas


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, gold) of a benchmark document."""
    documents = spark.read.option("multiLine", True).schema(schemas.BENCHMARK_FILE).json(path).select("knowledge_base_id", F.inline("documents"))
    mentions = documents.select(F.col("doc_id").alias("request_id"), F.col("text").alias("doc_text"), F.col("knowledge_base_id").alias("kb_id"), F.posexplode("mentions").alias("pos", "m"))
    mentions = mentions.select(
        "request_id", "doc_text", "kb_id", "pos", "m.mention_id", "m.text", "m.start", "m.end", "m.entity_type", "m.sentence",
        F.coalesce("m.metadata.candidate_aliases", F.array().cast("array<string>")).alias("candidate_aliases"),
        F.coalesce("m.metadata.coreference_hint", F.lit(False)).alias("coreference_hint"),
    )
    gold = documents.select(F.col("doc_id").alias("request_id"), F.inline("gold")).withColumn("is_alias", F.coalesce("is_alias", F.lit(False)))
    return mentions, gold


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.REQUEST).json(path)


def explode_requests(requests: DataFrame, keys: tuple[str, ...] = ("request_id",), outer: bool = False) -> DataFrame:
    """One row a mention, with the request's columns `keys`. Requests without mentions give none, or with
    `outer` one without pos: validation reports those."""
    none = F.array().cast("array<string>")
    exploded = F.posexplode_outer if outer else F.posexplode
    return requests.select(*keys, "kb_id", F.col("text").alias("doc_text"), exploded("mentions").alias("pos", "m")).select(
        *keys, "kb_id", "doc_text", "pos", "m.mention_id", "m.text", "m.start", "m.end", "m.entity_type", "m.sentence",
        F.coalesce("m.candidate_aliases", none).alias("candidate_aliases"), F.coalesce("m.coreference_hint", F.lit(False)).alias("coreference_hint"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """(norm_mention, entity_id, prior) of a prior document; a missing file is an empty prior."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.PRIOR)
    document = spark.read.option("multiLine", True).schema("source string, mentions int, mapping map<string,map<string,double>>").json(path)
    by_mention = document.select(F.explode("mapping").alias("norm_mention", "of"))
    return by_mention.select("norm_mention", F.explode("of").alias("entity_id", "prior"))


def prior_document(prior: DataFrame, source: str) -> DataFrame:
    """One JSON row {source, mentions, mapping}, a mention's entities from the most frequent on: for
    exchange; keep large priors as tables."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("prior")).alias("rank"), "entity_id", "prior")))
    of = prior.groupBy("norm_mention").agg(F.map_from_entries(F.transform(ranked, lambda x: F.struct(x["entity_id"].alias("key"), x["prior"].alias("value")))).alias("of"))
    whole = of.agg(F.count("*").alias("mentions"), F.map_from_entries(F.collect_list(F.struct("norm_mention", "of"))).alias("mapping"))
    return whole.select(F.to_json(F.struct(F.lit(source).alias("source"), "mentions", "mapping")).alias("value"))


def write_prior_table(prior: DataFrame, path: str) -> None:
    prior.write.mode("overwrite").parquet(path)


def trace_day(trace_id: str) -> str | None:
    found = re.search(r"-(\d{8})\d{6}-", trace_id)
    return found.group(1) if found else None


def write_traces(responses: DataFrame, path: str, batch: int | None = None) -> None:
    """Add traces to the table at path, by day of the trace id; the commit protocol leaves whole files
    or none. A numbered batch replaces what an earlier attempt of that number wrote."""
    day = F.regexp_extract("trace_id", r"-(\d{8})\d{6}-", 1)
    # Rows in order of day and id, and Bloom filters: one id reads the row group that may hold it.
    rows = responses.withColumn("day", F.when(day != "", day)).sortWithinPartitions("day", "trace_id")
    writer = rows.write.option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("day")
    if batch is None:
        writer.mode("append").parquet(f"{path}/batch=-1")
    else:
        writer.mode("overwrite").parquet(f"{path}/batch={batch}")


def persist(responses: DataFrame, path: str, batch: int | None = None) -> bool:
    """Write traces; False where that failed, and nothing of them is in the table then."""
    try:
        write_traces(responses, path, batch)
        return True
    except (PySparkException, Py4JError):
        return False


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All traces of the table, with their day."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


SHREDDING = "spark.sql.variant.inferShreddingSchema"


def write_events(responses: DataFrame, path: str) -> None:
    """Add the stages of responses to the table at path: a row a stage that ran (trace_id, number,
    detail), by day and node. Details are variants; a node's are alike, so that Spark shreds them into
    columns of their own and whoever asks for a field reads that field."""
    spark, day = responses.sparkSession, F.regexp_extract("trace_id", r"-(\d{8})\d{6}-", 1)
    single = responses.select("trace_id", F.when(day != "", day).alias("day"), F.posexplode("node_events").alias("number", "e"))
    rows = single.select("trace_id", "number", F.parse_json("e.detail").alias("detail"), "day", F.col("e.node").alias("node"))
    before = spark.conf.get(SHREDDING, None)
    spark.conf.set(SHREDDING, "true")
    try:
        rows.write.partitionBy("day", "node").mode("append").parquet(path)
    finally:
        spark.conf.unset(SHREDDING) if before is None else spark.conf.set(SHREDDING, before)


def read_events(spark: SparkSession, path: str, node: str | None = None) -> DataFrame:
    """(trace_id, node, number, detail): all stages, or those of one node, whose files alone are read."""
    rows = spark.read.schema("trace_id string, number int, detail variant, day string, node string").parquet(path)
    return (rows if node is None else rows.filter(F.col("node") == node)).select("trace_id", "node", "number", "detail")


class TraceNotFound(FileNotFoundError):
    pass


def get_trace(spark: SparkSession, path: str, trace_id: str) -> Row:
    """The trace; one that is not in the table is an error."""
    found = read_trace(spark, path, trace_id).first() if exists(spark, path) else None
    if found is None:
        raise TraceNotFound(trace_id)
    return found


def traces_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The traces of many ids(trace_id): one join, whose days prune what is read."""
    day = F.regexp_extract("trace_id", r"-(\d{8})\d{6}-", 1)
    wanted = ids.select("trace_id").distinct().withColumn("day", F.when(day != "", day).cast("int"))
    rows = read_traces(spark, path)
    dated = rows.join(wanted.filter("day is not null"), ["day", "trace_id"], "left_semi")
    return dated.unionByName(rows.filter("day is null").join(wanted.filter("day is null").select("trace_id"), "trace_id", "left_semi")).drop("day")


def read_trace(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """The trace's rows, none if unknown. Its day says which partition to read."""
    day, rows = trace_day(trace_id), read_traces(spark, path)
    of_day = F.col("day").isNull() if day is None else F.col("day") == F.lit(int(day))
    return rows.filter(of_day & (F.col("trace_id") == trace_id)).drop("day")

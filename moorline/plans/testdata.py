"""Knowledge bases and mentions derived from the star-schema tables, for queries over them.

Each derivation is a deterministic projection or join of whole tables, spelled once for Spark and
once as SQL for other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KB = "catalog"
NONE = "array<string>"
#: A character for each region, whose alias is that character twice, and two that no alias holds. Aliases and
#: mentions that share them are alike in one run of one character, so that SQL can tell their similarity.
REGIONS, NOBODY = "甲乙丙丁戊", "己庚"
#: Latin letters to Han characters, for the overlap of descriptions.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(number) -> Column:
    return F.substring(F.lit(REGIONS + NOBODY), (number % 7 + 1).cast("int"), F.lit(1))


def catalog_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as entities; parts share names."""

    def rows(name: str, rank: int, key: str, label, aliases, keywords) -> DataFrame:
        kind = name
        return table(spark, sf_dir, name).select(
            F.lit(KB).alias("kb_id"), F.lit("1").alias("version"), (F.col(key).cast("long") + rank * 10_000_000).alias("entity_ord"),
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("entity_id"), label.alias("canonical_name"), aliases.alias("aliases"),
            F.lit(kind).alias("entity_type"), keywords.alias("keywords"), F.lit("").alias("description"), F.lit(None).cast("string").alias("metadata_json"),
        )

    none = F.array().cast(NONE)
    words = F.concat(F.array("p_type", "p_brand"), F.split("p_name", " "))
    return (
        rows("region", 0, "r_regionkey", F.col("r_name"), F.array(F.repeat(letter(F.col("r_regionkey")), F.lit(2))), none)
        .unionByName(rows("nation", 1, "n_nationkey", F.col("n_name"), none, none))
        .unionByName(rows("customer", 2, "c_custkey", F.col("c_name"), none, F.array("c_mktsegment")))
        .unionByName(rows("supplier", 3, "s_suppkey", F.col("s_name"), none, none))
        .unionByName(rows("part", 4, "p_partkey", F.concat_ws(" ", "p_name", "p_brand"), F.array("p_name"), words))
    )


CATALOG_KB = f"""
kb AS (
  SELECT r_regionkey::BIGINT AS entity_ord, 'region:' || r_regionkey AS entity_id, r_name AS canonical_name, [repeat(substr('{REGIONS}', r_regionkey::INTEGER + 1, 1), 2)] AS aliases, 'region' AS entity_type, []::VARCHAR[] AS keywords FROM region
  UNION ALL SELECT 10000000 + n_nationkey, 'nation:' || n_nationkey, n_name, [], 'nation', [] FROM nation
  UNION ALL SELECT 20000000 + c_custkey, 'customer:' || c_custkey, c_name, [], 'customer', [c_mktsegment] FROM customer
  UNION ALL SELECT 30000000 + s_suppkey, 'supplier:' || s_suppkey, s_name, [], 'supplier', [] FROM supplier
  UNION ALL SELECT 40000000 + p_partkey, 'part:' || p_partkey, p_name || ' ' || p_brand, [p_name], 'part', [p_type, p_brand] || string_split(p_name, ' ') FROM part)"""

#: Every column of lineitem, so that the order of equal order lines is the same everywhere.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def line_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each order line: the part's name in some spelling, one like a region's alias or
    like none, or a pronoun."""
    # Numbered over all lines of an order, parts known or not, before parts are looked up: only numbers meet them,
    # and where parts are few, lines stay dealt by request, so that grouping by it moves nothing.
    order = Window.partitionBy("request_id").orderBy(*LINE_ORDER)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").withColumn("request_id", F.col("l_orderkey").cast("string"))
    numbered = lines.withColumn("pos", F.row_number().over(order) - 1).select("request_id", "pos", "l_partkey")
    rows = numbered.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("pos") % 4
    text = (
        F.when(k == 0, F.col("p_name"))
        .when(k == 1, F.upper("p_name"))
        .when(k == 2, F.concat_ws(" ", "p_name", "p_brand"))
        .when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("某"), F.repeat(letter(F.col("l_partkey")), (F.floor(F.col("l_partkey") / 7) % 3 + 1).cast("int")), F.when(F.col("l_partkey") % 2 == 0, F.lit("货")).otherwise(F.lit(""))))
        .when(F.col("l_partkey") % 3 == 1, F.lit("其"))
        .otherwise(F.lit("己"))
    )
    region = (k == 3) & (F.col("l_partkey") % 3 == 0) & (F.col("l_partkey") % 7 < 5)
    sentence = F.concat(F.lit("The order asks for "), F.when(F.col("l_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit("goods")), F.lit(" of "), F.col("p_brand"), F.lit("."))
    return rows.select(
        "request_id", F.lit(KB).alias("kb_id"), sentence.alias("doc_text"), "pos",
        F.concat_ws("-", "request_id", F.col("pos").cast("string")).alias("mention_id"), text.alias("text"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.when(F.col("pos") % 2 == 0, F.lit("part")).alias("entity_type"), sentence.alias("sentence"),
        F.when(F.col("pos") % 5 == 4, F.array(F.concat(F.lit(" "), F.col("p_name")))).otherwise(F.array().cast(NONE)).alias("candidate_aliases"),
        ((k == 3) & (F.col("l_partkey") % 3 == 2)).alias("coreference_hint"),
        F.when(region, F.concat(F.lit("region:"), (F.col("l_partkey") % 7).cast("string"))).otherwise(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("gold_kb_id"),
    )


LINE_MENTIONS = f"""
lines AS (
  SELECT l.l_orderkey, l.l_partkey, p.p_name, p.p_brand, p.p_type, l.pos FROM
    (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1)::INTEGER AS pos FROM lineitem) l JOIN part p ON l.l_partkey = p.p_partkey),
mentions AS (
  SELECT l_orderkey::VARCHAR AS request_id, pos, l_orderkey || '-' || pos AS mention_id,
    CASE WHEN pos % 4 = 0 THEN p_name WHEN pos % 4 = 1 THEN upper(p_name) WHEN pos % 4 = 2 THEN p_name || ' ' || p_brand
      WHEN l_partkey % 3 = 0 THEN '某' || repeat(substr('{REGIONS}{NOBODY}', (l_partkey % 7)::INTEGER + 1, 1), l_partkey // 7 % 3 + 1) || CASE WHEN l_partkey % 2 = 0 THEN '货' ELSE '' END
      WHEN l_partkey % 3 = 1 THEN '其' ELSE '己' END AS text,
    CASE WHEN pos % 2 = 0 THEN 'part' END AS entity_type,
    'The order asks for ' || CASE WHEN l_partkey % 2 = 0 THEN p_type ELSE 'goods' END || ' of ' || p_brand || '.' AS context,
    CASE WHEN pos % 5 = 4 THEN [p_name] ELSE []::VARCHAR[] END AS expansions,
    (pos % 4 = 3 AND l_partkey % 3 != 0) AS hint, CASE WHEN pos % 4 = 3 AND l_partkey % 3 = 0 AND l_partkey % 7 < 5 THEN 'region:' || (l_partkey % 7) ELSE 'part:' || l_partkey END AS gold
  FROM lines)"""


# -- a base of product lines and slips of the pen, for fuzzy retrieval -----------------------------

LINES = "lines"


def lines_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lines, types and nations: a base that stays small whatever the scale, with several
    aliases an entity."""
    parts = table(spark, sf_dir, "part")
    name, types = F.col("p_name"), F.col("p_type")
    words = F.split(name, " ")
    lines = parts.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    lines = lines.select(F.col("k").cast("long").alias("entity_ord"), F.concat(F.lit("line:"), name).alias("entity_id"), name.alias("canonical_name"), F.array(F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))), F.concat(F.lit("the "), F.get(words, F.lit(1)))).alias("aliases"))
    kinds = parts.groupBy("p_type").agg(F.min("p_partkey").alias("k")).select((F.col("k") + 10_000_000_000).cast("long").alias("entity_ord"), F.concat(F.lit("type:"), types).alias("entity_id"), types.alias("canonical_name"), F.array(F.concat(types, F.lit(" goods"))).alias("aliases"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 20_000_000_000).cast("long").alias("entity_ord"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("canonical_name"), F.array().cast(NONE).alias("aliases"))
    rows = lines.unionByName(kinds).unionByName(nations)
    return rows.select(F.lit(LINES).alias("kb_id"), F.lit("1").alias("version"), "entity_ord", "entity_id", "canonical_name", "aliases", F.lit("line").alias("entity_type"), F.array().cast(NONE).alias("keywords"), F.lit("").alias("description"), F.lit(None).cast("string").alias("metadata_json"))


LINES_KB = """
kb AS (
  SELECT min(p_partkey)::BIGINT AS entity_ord, 'line:' || p_name AS entity_id, p_name AS canonical_name, [string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1], 'the ' || string_split(p_name, ' ')[2]] AS aliases FROM part GROUP BY p_name
  UNION ALL SELECT min(p_partkey) + 10000000000, 'type:' || p_type, p_type, [p_type || ' goods'] FROM part GROUP BY p_type
  UNION ALL SELECT n_nationkey + 20000000000, 'nation:' || n_nationkey, n_name, [] FROM nation)"""


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text, candidate_aliases): a name for each part as it may be mistyped: a letter left
    out or doubled, other vowels, words cut short, brands and numbers beside it; some right ones."""
    key, name = F.col("p_partkey"), F.col("p_name")
    k, at = key % 7, (F.floor(key / 7) % F.length("p_name") + 1).cast("int")
    head, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length("p_name"))
    words = F.split(name, " ")
    text = (
        F.when(k == 0, F.concat(head, tail))
        .when(k == 1, F.concat(head, F.substring(name, at, F.lit(1)), F.substring(name, at, F.length("p_name"))))
        .when(k == 2, F.concat(F.translate(name, "aeiou", "eioua"), F.lit(" "), F.col("p_brand")))
        .when(k == 3, F.concat(F.substring(name, 1, 4), F.lit(" "), F.lower("p_type"), F.lit(" "), F.substring(F.col("p_brand"), 6, 4)))
        .when(k == 4, F.concat(F.get(words, F.lit(1)), F.lit(" no "), key.cast("string")))
        .when(k == 5, F.concat(F.lit("Q"), key.cast("string"), F.lit("xjvz")))
        .otherwise(F.concat(F.lit("some "), name, F.lit(" of "), F.col("p_brand")))
    )
    expansion = F.when(key % 11 == 0, F.array(F.concat(F.get(words, F.lit(1)), F.lit("s")))).otherwise(F.array().cast(NONE))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit(LINES).alias("kb_id"), text.alias("text"), expansion.alias("candidate_aliases"))


SLIPS = """
slips AS (
  SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN substr(p_name, 1, spot - 1) || substr(p_name, spot + 1) WHEN 1 THEN substr(p_name, 1, spot) || substr(p_name, spot)
      WHEN 2 THEN translate(p_name, 'aeiou', 'eioua') || ' ' || p_brand WHEN 3 THEN substr(p_name, 1, 4) || ' ' || lower(p_type) || ' ' || substr(p_brand, 6, 4)
      WHEN 4 THEN string_split(p_name, ' ')[2] || ' no ' || p_partkey WHEN 5 THEN 'Q' || p_partkey || 'xjvz' ELSE 'some ' || p_name || ' of ' || p_brand END AS text,
    CASE WHEN p_partkey % 11 = 0 THEN [string_split(p_name, ' ')[2] || 's'] ELSE []::VARCHAR[] END AS expansions
  FROM (SELECT *, (p_partkey // 7 % length(p_name) + 1)::INTEGER AS spot FROM part))"""

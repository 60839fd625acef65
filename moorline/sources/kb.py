"""Knowledge bases: files, inline rows, the built-in catalog, and their alias index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorline import schemas
from moorline.functions.text import let, normalize
from moorline.options import CCKS_KB, DEFAULT_KB


class UnknownKnowledgeBase(ValueError):
    pass


class Catalog:
    """Named knowledge bases. Tables are read once and kept; register() replaces one."""

    def __init__(self, spark: SparkSession, paths: dict[str, str] | None = None, ccks: str = CCKS_KB):
        self.spark, self.paths, self.ccks, self.tables = spark, dict(paths or {}), ccks, {}

    def register(self, kb_id: str, entities: DataFrame) -> None:
        self.tables[kb_id] = entities

    def listing(self) -> DataFrame:
        rows = [(k, self.paths.get(k)) for k in sorted({*self.paths, *self.tables})]
        return self.spark.createDataFrame(rows, "kb_id string, path string")

    def load(self, kb_id: str | None = None, inline: DataFrame | list | None = None) -> DataFrame:
        """Inline entities (an empty list counts) before a named base before the default one."""
        if inline is not None:
            rows = inline if isinstance(inline, DataFrame) else self.spark.createDataFrame(inline, schemas.ENTITY)
            return rows.withColumns({"version": F.lit("inline"), "kb_id": F.coalesce("kb_id", F.lit(kb_id or "inline"))})
        from moorline.sources.ccks import load_entities

        name = kb_id or DEFAULT_KB
        if name not in self.tables:
            if name not in self.paths:
                raise UnknownKnowledgeBase(name)
            path = self.paths[name]
            # Entity lines of the CCKS kind are a base of their own form.
            self.tables[name] = load_entities(self.spark, path, kb_id=name) if name == self.ccks else read_kb(self.spark, path, name)
        return self.tables[name]


def entity_columns() -> list[Column]:
    """Columns of an entity `e` as documents state it, missing parts empty."""
    none = F.array().cast("array<string>")
    return [
        F.col("e.entity_id"), F.col("e.canonical_name"), F.coalesce("e.aliases", none).alias("aliases"), F.col("e.entity_type"), F.coalesce("e.keywords", none).alias("keywords"),
        F.coalesce(F.get_json_object("e.metadata", "$.description"), F.lit("")).alias("description"), F.col("e.metadata").alias("metadata_json"),
    ]


def read_kb(spark: SparkSession, path: str, kb_id: str | None = None) -> DataFrame:
    """Entities of a JSON document {kb_id, version, entities: [...]}, missing parts empty; a document
    without a name or version takes kb_id for both."""
    document = spark.read.option("multiLine", True).schema(schemas.KB_FILE).json(path)
    name = F.lit(kb_id).cast("string")
    rows = document.select(F.coalesce("kb_id", name).alias("kb_id"), F.coalesce("version", name).alias("version"), F.posexplode("entities").alias("entity_ord", "e"))
    return rows.select("kb_id", "version", F.col("entity_ord").cast("long"), *entity_columns())


def inline_entities(requests: DataFrame, base: str) -> DataFrame:
    """Entities that requests bring along in `inline_kb`, named by the column `base`, each base once."""
    rows = requests.select(F.col(base).alias("kb_id"), F.posexplode("inline_kb.entities").alias("entity_ord", "e"))
    return rows.select("kb_id", F.lit("inline").alias("version"), F.col("entity_ord").cast("long"), *entity_columns()).dropDuplicates(["kb_id", "entity_ord"])


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """Entity ids that a base holds more than once; such a base must not be linked against."""
    return entities.groupBy("kb_id", "entity_id").count().filter("count > 1")


def aliases(entities: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(kb_id, entity_ord, entity_id, alias_ord, alias, norm, and carried): the name and every alias,
    each normalised form once an entity (its first), empty ones left out."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    marked = F.transform(names, lambda x, i: F.struct(i.alias("alias_ord"), x.alias("alias"), normalize(x).alias("norm")))
    # Worked out once an entity: inside the filter it would be once for each of the names.
    first = let(marked, lambda all: F.filter(all, lambda s, i: (F.coalesce(s["norm"], F.lit("")) != "") & (F.array_position(all["norm"], s["norm"]) == i + 1)))
    return entities.select("kb_id", "entity_ord", "entity_id", *carried, F.inline(first)).select("kb_id", "entity_ord", "entity_id", "alias_ord", "alias", "norm", *carried)


def alias_index(entities: DataFrame, cap: int) -> DataFrame:
    """Aliases, the first `cap` entities of each. Retrieval takes no more than cap entities a mention
    in this order, so longer tails of a very common name cannot matter and never join."""
    order = Window.partitionBy("kb_id", "norm").orderBy("entity_ord")
    return aliases(entities).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= cap).drop("_k")


def subset(entities: DataFrame, ids: DataFrame | None = None, alias_texts: DataFrame | None = None) -> DataFrame:
    """Entities whose id is among ids(entity_id) or one of whose aliases is among alias_texts(text).

    Without either, all; an empty table of ids with no alias texts is a filter that nothing passes.
    """
    if ids is None and alias_texts is None:
        return entities
    kept = []
    if ids is not None:
        kept.append(entities.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("kb_id", "entity_id"))
    if alias_texts is not None:
        wanted = alias_texts.select(normalize(F.col("text")).alias("norm")).filter("norm != ''").distinct()
        kept.append(aliases(entities).join(wanted, "norm", "left_semi").select("kb_id", "entity_id"))
    found = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
    return entities.join(found.distinct(), ["kb_id", "entity_id"], "left_semi").select(*entities.columns)
